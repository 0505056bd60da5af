"""Suffix-array dedup: bytes inside a string of ``length`` bytes that starts twice.

Refinement of fingerprints over start positions, in place of prefix doubling: no
rank is computed and nothing is sorted. Positions are grouped by hashes of
growing prefixes; those alone in a group drop out, the rest are grouped again by a
longer prefix, up to the threshold. To rank all bytes of a corpus one by one would cost a sorted row for
each, so positions are grouped as runs: first by the least 32-byte piece inside
their window (``windows``), then in blocks of starts (64, then 8, then 1 wide)
by the prefix that all starts of the block share (``length`` - width + 1 bytes
from the last of them), which reaches ``length`` at width 1. A block whose shared prefix is
unique is done, as is one whose whole content occurs twice; only blocks with
equal prefixes and different contents are split further, one for each content.

Strings never cross documents and are judged on the input. Defined results: a
null or empty text has 0 bytes; shorter texts lose nothing; repeated rows are
further copies; texts are read whole however long (a chunk of work holds one text at least);
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import keyed, materialize, on_key, small_batches
from lexiforge.llm.rolling import byte_sums, chunks, mix
from lexiforge.llm.windows import cut, flat_list, lists_by_row, runs, span

LENGTH = 400
PIECE = 32
WIDTHS = (64, 8, 1)
_BLOCK = "seg long, weight int, h long, b int, core long, full long, lo int, m int"


def _segments(docs: DataFrame, contents: DataFrame, length: int) -> DataFrame:
    """The bytes of one run of each content, with what is needed to place them."""
    listed = lists_by_row(contents, F.struct("h", "d", "s", "m", "weight"), "runs")
    schema = "seg long, row_key long, doc_id long, h long, weight int, d int, s int, m int, bytes binary"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, data, at in chunks(batch.column("text")):
                row, item = flat_list(batch.column("runs"), i, j)
                begin = at[row] + item["s"]
                size = item["m"].astype(np.int64) - 1 + length
                ends = np.concatenate([[0], np.cumsum(size)])
                where = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
                taken = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[where])])
                rows = pa.array(row + i)
                key = batch.column("row_key").take(rows)
                seg = mix(key.to_numpy().view(np.uint64) + item["s"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg), key, batch.column("doc_id").take(rows), *(pa.array(item[n]) for n in ("h", "weight", "d", "s", "m")), taken.cast(pa.binary())],
                    ["seg", "row_key", "doc_id", "h", "weight", "d", "s", "m", "bytes"],
                )

    return on_key(docs, listed, "inner").select("row_key", "doc_id", "text", "runs").mapInArrow(batches, schema)


def _blocks(segments: DataFrame, open_blocks: DataFrame, width: int, length: int) -> DataFrame:
    """The open stretches of starts of the segments, cut into blocks of ``width``; _BLOCK."""
    listed = open_blocks.groupBy("seg").agg(F.collect_list(F.struct("lo", "m", "weight")).alias("open"))
    rows = segments.select("seg", "h", "d", "bytes").join(listed, "seg")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            h, d = batch.column("h").to_numpy(), batch.column("d").to_numpy().astype(np.int64)
            for i, j, data, at in chunks(batch.column("bytes")):
                row, item = flat_list(batch.column("open"), i, j)
                sums = byte_sums(data)
                anchor = d[i + row]
                # starts lo .. lo+m-1 lie far = anchor - start from the anchor; blocks hold far // width
                first, last = (anchor - item["lo"]) // width, (anchor - item["lo"] - item["m"] + 1) // width
                count = first - last + 1
                each = np.repeat(np.arange(len(row)), count)
                b = first[each] - (np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count))
                lo = np.maximum(item["lo"][each], anchor[each] - (b * width + width - 1))
                end = np.minimum(item["lo"][each] + item["m"][each], anchor[each] - b * width + 1)
                base = at[row[each]]
                core = mix(sums.stretch(base + anchor[each] - b * width, base + anchor[each] - (b * width + width - 1) + length))
                place = (anchor[each] - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (end - lo).astype(np.uint64)
                full = mix(sums.stretch(base + lo, base + end - 1 + length) + place)
                rows = pa.array(row[each] + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("seg").take(rows), pa.array(item["weight"][each].astype(np.int32)), pa.array(h[i + row[each]]), pa.array(b.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array((end - lo).astype(np.int32))],
                    ["seg", "weight", "h", "b", "core", "full", "lo", "m"],
                )

    return rows.mapInArrow(batches, _BLOCK)


def removal_spans(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """row_key, doc_id and span (bytes from s to before e) of what is to go."""
    if widths[-1] != 1 or max(widths) > length - piece + 1:
        raise ValueError("widths must end with 1 and leave a shared prefix")
    with small_batches(docs.sparkSession):
        return _spans(docs, length, piece, widths)


def _spans(docs: DataFrame, length: int, piece: int, widths: tuple[int, ...]) -> DataFrame:
    found = materialize(runs(docs, "byte", length, piece), "byte-runs")
    anchors = found.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    shared = materialize(anchors.where("n > 1").select("h", (F.col("c0") != F.col("c1")).alias("mixed")), "shared-anchors")
    closer = materialize(found.join(shared, "h"), "shared-runs")
    whole = span(F.col("s"), F.col("s") + F.col("m") - 1 + length).alias("span")
    spans = closer.where("not mixed").select("row_key", "doc_id", whole)
    mixed = closer.where("mixed")
    contents = mixed.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "doc_id", "s", "d", "m")).alias("r"))
    contents = materialize(contents, "contents")
    spans = spans.unionByName(mixed.join(contents.where("n > 1").select("h", "c"), ["h", "c"]).select("row_key", "doc_id", whole))
    ranked = contents.select("h", "r.*", F.least("n", F.lit(2)).cast("int").alias("weight"))
    segments = materialize(_segments(docs, ranked, length), "segments")
    open_blocks = segments.select("seg", F.lit(0).alias("lo"), "m", "weight")
    for width in widths:
        blocks = materialize(_blocks(segments, open_blocks, width, length), f"blocks-{width}")
        names = ["h", "b", "core", "full"]
        content = materialize(blocks.groupBy(*names).agg(F.sum("weight").alias("n"), F.min(F.struct("seg", "lo", "m")).alias("r")), f"ranks-{width}")
        twice = blocks.where("weight = 1").join(content.where("n > 1").select(*names), names).select("seg", "lo", "m")
        placed = twice.join(segments.select("seg", "row_key", "doc_id", F.col("s").alias("at")), "seg")
        start = F.col("at") + F.col("lo")
        spans = spans.unionByName(placed.select("row_key", "doc_id", span(start, start + F.col("m") - 1 + length).alias("span")))
        if width > 1:
            split = materialize(content.groupBy("h", "b", "core").agg(F.count("*").alias("k")).where("k > 1").drop("k"), f"split-{width}")
            open_blocks = materialize(content.join(split, ["h", "b", "core"]).select("r.seg", "r.lo", "r.m", F.least("n", F.lit(2)).cast("int").alias("weight")), f"open-{width}")
    return materialize(spans, "byte-spans")


def dedup_strings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, widths: tuple[int, ...] = WIDTHS, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) of each document."""
    docs = keyed(docs, id_col, text_col)
    return cut(docs, removal_spans(docs, length, piece, widths), "byte", text)
