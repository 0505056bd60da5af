"""Deterministic sharded WARC writer, and a reader.

Pages are range-sorted by host-reversed URL and id. Shards are the stretches of that order between multiples of
``shard_bytes`` (with at most ``MOST_SHARDS`` shards; larger tables have larger ones), found by running sums over a narrow
table; a shard begins with the row whose bytes hold the multiple. Equal rows that fill more than a shard are counted, and
as many are written again in each of the shards that begin with them (the first ones get one more if they do not divide). Within a shard, files are rolled when their compressed
size reaches ``roll_bytes``. Every record is a gzip member of its own with fresh
headers and digests, so the same table gives the same bytes in the same files.
A task writes under a temporary name of its own and reports it; the reports that Spark accepts become the
manifest, whose files are then renamed. What a lost or
repeated task wrote is named nowhere and goes with the temporary folder.

Of records with equal payloads of at least ``least_revisit`` bytes, the one with the
smallest id is a response and the others revisit it. Defined results: a null html is an empty payload, a null url
``urn:page:<id>``; a null id is smaller than none, so its page is a response; repeated rows with the smallest id are
all responses; payloads are whole however large (a task holds one record at a time); line breaks in a url become %0A and %0D; other columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import WorkTable, drop_path, materialize

SHARD_BYTES = 16 << 20
ROLL_BYTES = 4 << 20
LEAST_REVISIT = 100
#: The first rows of so many shards are held by the driver and the tasks.
MOST_SHARDS = 1 << 16
#: Bytes that a record has besides its payload, about.
RECORD_BYTES = 700
WARC_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, number int, temporary string, file string, bytes long, records long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _record_id(page_id: int | None, digest: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None = None, first_url: str | None = None) -> bytes:
    """One WARC record: a response, or a revisit of the page ``first_id``."""
    clean = lambda u, i: (u or f"urn:page:{i}").replace("\r", "%0D").replace("\n", "%0A")
    url, digest = clean(url, page_id), hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first_id is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first_id is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest, url)}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if first_id is not None:
        first_url = clean(first_url, first_id)
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(first_id, digest, first_url)}", f"WARC-Refers-To-Target-URI: {first_url}", f"X-Refers-To-Page-ID: {first_id}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # no name and no time in the header
    return packer.compress(data) + packer.flush()


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{base}/_temporary", recursive=True)
        out = None
        shard, number = None, 0

        def done() -> pa.RecordBatch:
            out["stream"].close()
            row = [shard, number, out["name"], f"part-{shard:05d}-{number:05d}.warc.gz", out["bytes"], out["records"], out["sha"].hexdigest()]
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema)

        for batch in batches:
            for r in batch.to_pylist():
                if out and (r["shard"] != shard or out["bytes"] >= roll_bytes):
                    yield done()
                    number, out = (number + 1 if r["shard"] == shard else 0), None
                if out is None:
                    shard, name = r["shard"], f"{uuid.uuid4().hex}.warc.gz"
                    out = {"name": name, "stream": store.open_output_stream(f"{base}/_temporary/{name}", compression=None), "bytes": 0, "records": 0, "sha": hashlib.sha256()}
                packed = _gzip(record(r["page_id"], r["url"], r["payload"], r["first_id"], r["first_url"]))
                out["stream"].write(packed)
                out["sha"].update(packed)
                out["bytes"] += len(packed)
                out["records"] += 1
        if out:
            yield done()

    names = [x.split()[0] for x in MANIFEST.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, MANIFEST.split(", "), strict=True)])
    return write


def _commit(folder: str):
    """Renames the files of the manifest; a file that has its name already is left."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                if store.get_file_info(f"{base}/_temporary/{r['temporary']}").type == fs.FileType.File:
                    store.move(f"{base}/_temporary/{r['temporary']}", f"{base}/{r['file']}")
                size = store.get_file_info(f"{base}/{r['file']}").size
                if size != r["bytes"]:
                    raise OSError(f"{r['file']} has {size} bytes, the manifest says {r['bytes']}")
            yield batch

    return rename


def _key(place: str, page_id: int | None, row_key: int) -> tuple:
    """In the order in which Spark sorts: places by their UTF-8 bytes, a null id before all others."""
    return place.encode(), page_id is not None, page_id or 0, row_key


def _first_rows(brief: DataFrame, shard_bytes: int) -> list[tuple]:
    """Key of the row that each multiple of ``shard_bytes`` falls into, in order; the sums are exact, wherever partitions end."""
    order = ["place", "page_id", "row_key"]
    own = F.col("size") + RECORD_BYTES

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            upto = before + np.cumsum(batch.column("own").to_numpy())
            before = int(upto[-1]) if len(upto) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto, pa.int64())], [*batch.schema.names, "upto"])

    ordered = brief.select(*order, own.cast("long").alias("own")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = WorkTable(ordered.mapInArrow(sums, "place string, page_id long, row_key long, own long, part int, upto long"), "running-sums")
    parts = placed.df.groupBy("part").agg(F.max("upto").alias("bytes"))  # a row for each partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("start"))
    end = F.col("start") + F.col("upto")
    held = F.floor((end - 1) / shard_bytes) - F.floor((end - F.col("own") - 1) / shard_bytes)  # multiples in the row's bytes
    first = placed.df.join(F.broadcast(starts), "part").select(*order, held.alias("held")).where("held > 0").collect()  # at most MOST_SHARDS rows
    return sorted(_key(r["place"], r["page_id"], r["row_key"]) for r in first for _ in range(r["held"]))


def _shard_of(cuts: list[tuple]):
    """``last``, the number of cuts at or before a row, and ``several``, how many of them are the row's own."""

    @F.pandas_udf("last int, several int")
    def shard(places: pd.Series, ids: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for place, page_id, row_key in zip(places, ids, keys, strict=True):
            key = _key(place, None if pd.isna(page_id) else int(page_id), row_key)
            last = bisect_right(cuts, key)
            out.append((last, last - bisect_left(cuts, key)))
        return pd.DataFrame(out, columns=["last", "several"], dtype="int32")

    return shard


def _sharded(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``rows`` with shard and copies; of equal rows that fill several shards one is left for each of these."""
    if not cuts:
        return rows.withColumns({"shard": F.lit(0), "copies": F.lit(1)})
    placed = rows.withColumn("cut", _shard_of(cuts)("place", "page_id", "row_key"))
    one = placed.withColumns({"shard": F.col("cut.last"), "copies": F.lit(1)})
    if len(set(cuts)) == len(cuts):  # no row's bytes hold two multiples
        return one.drop("cut")
    several = F.col("cut.several")
    equal = placed.where(several > 1).groupBy("page_id", "place", "row_key", "cut").agg(F.any_value("url").alias("url"), F.any_value("payload").alias("payload"), F.count("*").alias("n"))
    dealt = equal.withColumn("i", F.explode(F.sequence(F.lit(0), several - 1)))
    dealt = dealt.withColumns({"shard": F.col("cut.last") - several + 1 + F.col("i"), "copies": (F.floor(F.col("n") / several) + F.when(F.col("i") < F.col("n") % several, 1).otherwise(0)).cast("int")})
    names = [*rows.columns, "shard", "copies"]
    return one.where(several <= 1).select(names).unionByName(dealt.where("copies > 0").select(names))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Writes the archives and their manifest into a new folder; returns the manifest."""
    spark = pages.sparkSession
    payload = F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    host = F.lower(F.coalesce(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    place = F.concat_ws(",", F.array_join(F.reverse(F.split(host, "\\.")), ","), F.coalesce("url", F.lit("")))
    rows = rows.withColumn("place", place).withColumn("row_key", F.xxhash64("page_id", "url", "payload"))
    brief = materialize(rows.select("page_id", "url", "place", "row_key", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest")), "pages-brief")
    groups = brief.where(f"size >= {least_revisit}").groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
    firsts = materialize(groups.where("n > 1 and first_id is not null").select("digest", "first_id"), "first-pages")
    first_urls = brief.join(firsts.withColumnRenamed("digest", "d"), (F.col("page_id") == F.col("first_id")) & (F.col("digest") == F.col("d"))).groupBy("digest", "first_id").agg(F.min("url").alias("first_url"))
    first_urls = materialize(first_urls, "first-urls")
    later = materialize(brief.join(first_urls, "digest").where("page_id > first_id").select("row_key", F.col("page_id").alias("later_id"), "first_id", "first_url").distinct(), "revisits")

    total = brief.agg(F.coalesce(F.sum("size"), F.lit(0)) + F.count("*") * RECORD_BYTES).first()[0]
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    n_shards = max(1, -(-total // shard_bytes))
    cuts = _first_rows(brief, shard_bytes) if n_shards > 1 else []
    sharded = _sharded(rows, cuts)
    same = (F.col("row_key") == F.col("late_key")) & (F.col("page_id") == F.col("later_id"))
    told = sharded.join(later.withColumnRenamed("row_key", "late_key"), same, "left")
    # copies are made where they are written
    ordered = told.repartitionById(n_shards, F.col("shard")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).sortWithinPartitions("shard", "place", "page_id", "row_key")
    written = ordered.select("shard", "page_id", "url", "payload", "first_id", "first_url").mapInArrow(_writer(folder, roll_bytes), MANIFEST)
    manifest = WorkTable(written, "warc-files")
    committed = manifest.df.repartition(max(1, n_shards), "file").mapInArrow(_commit(folder), MANIFEST)
    committed.write.parquet(f"{folder}/_manifest")
    manifest.drop()
    drop_path(spark, f"{folder}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    packed = b""
    while True:
        opened, parts = zlib.decompressobj(31), []
        while not opened.eof:
            packed = packed or stream.read(1 << 20)
            if not packed:
                if parts:
                    raise OSError("the archive ends inside a record")
                return
            parts.append(opened.decompress(packed))
            packed = opened.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> dict:
    """One record as RECORDS; its digests are checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise OSError(f"record {fields.get('WARC-Record-ID')} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise OSError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda x: int(x) if x is not None else None
    return {
        "page_id": number(fields.get("X-Page-ID")),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": int(http_fields["Content-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields.get("X-Refers-To-Page-ID")),
        "payload": payload if kind == "response" else None,
    }


def _reader(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                some, size = [], 0
                with store.open_input_stream(f"{base}/{r['file']}", compression=None) as stream:
                    for member in _members(stream):
                        some.append(parse(member))
                        size += len(member)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(some, schema)
                            some, size = [], 0
                yield pa.RecordBatch.from_pylist(some, schema)

    return read


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives that the folder's manifest names, RECORDS."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("file", "bytes")
    # Rows of the manifest are small, archives are not: a number of partitions that is given is not reduced at run time.
    return files.repartition(max(1, files.count()), "file").mapInArrow(_reader(folder), RECORDS)
