"""b-bit MinHash near-duplicates: connected components of documents with Jaccard >= 0.75.

Every document gets ``BANDS * ROWS`` minima over its set of five-word shingles.
The full minima of each band make its bucket key; of each minimum only the low
``BITS`` bits stay in a packed signature. Documents with equal sets are one
node. In the buckets of the first ``STAR_BANDS`` bands the least node is compared with the others: the signatures'
equal lanes, corrected for chance collisions, estimate the similarity, and pairs
that may reach the threshold are confirmed on the full sets. That connects most
of a group of copies, which need no further comparison. Buckets of any band in
which several components are left form clusters; there the nodes outside the
largest component are asked against all nodes of the cluster, in blocks, again by
estimate and then on the full sets. So every link between components that share a
bucket is found if its estimate is not five standard deviations too low, and a group of
copies costs a few comparisons for each, not one for each pair.

A pair at the threshold shares no bucket with probability (1 - 0.75**4)**32 = 5e-6, and is estimated
under ``LEAST_ESTIMATE`` with probability 1e-6 (binomial with 128 lanes).

Defined results: a null, empty or wordless text has no shingles and is linked
with nothing; fewer than five words are one shingle; rows with equal doc_id are one
document; a null doc_id has a null component and is kept; texts are read whole however long (a chunk of work holds one text at least);
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import keyed, materialize, on_key
from lexiforge.llm.components import NARROW, components
from lexiforge.llm.rolling import Words, chunks, mix

SHINGLE = 5
ROWS, BANDS, BITS = 4, 32, 2
#: Bands whose buckets are looked at as stars; the rest only where they join different components.
STAR_BANDS = 8
LEAST_PERCENT = 75
#: Pairs estimated below this are not looked at: five standard deviations under the threshold.
LEAST_ESTIMATE = 0.52
#: Rows with a signature or a set in a file.
WIDE = 10_000
#: Nodes of a block that is asked, and of a block it is compared with, and the most shingles that either is made for.
ASKED_BLOCK, OTHERS_BLOCK, BLOCK_SHINGLES = 256, 2048, 4_000_000

_random = np.random.Generator(np.random.PCG64(8))
_TIMES = _random.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_PLUS = _random.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64)


def _shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each shingle, in order, repeats included."""
    words = Words(data, at, lower=True)
    sums = words.sequence()
    full = np.flatnonzero(words.inside(SHINGLE))
    count = np.diff(words.first, append=len(words.doc))[: len(at) - 1]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    start = np.concatenate([full, words.first[short]])
    end = np.concatenate([full + SHINGLE, words.first[short] + count[short]])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    return words.doc[start], mix(sums.stretch(start, end) + (end - start).astype(np.uint64))


def _distinct(doc: np.ndarray, shingle: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats, by document and hash."""
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    return doc[new], shingle[new]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, at in chunks(batch.column("text")):
            n = j - i
            doc, shingle = _shingles(data, at)
            salted = shingle ^ mix(np.arange(1, n + 1, dtype=np.uint64))[doc]
            _, first = np.unique(salted, return_index=True)
            size = np.bincount(doc[first], minlength=n).astype(np.int64)
            prints = []
            for k in (1, 2):
                total = np.zeros(n, np.uint64)
                np.add.at(total, doc[first], mix(shingle[first] + np.uint64(k)))
                prints.append(total)
            some = np.flatnonzero(size)
            begin = np.searchsorted(doc, some)
            minima = np.empty((len(some), ROWS * BANDS), np.uint64)
            if len(some):
                for p in range(ROWS * BANDS):
                    minima[:, p] = np.minimum.reduceat(shingle * _TIMES[p] + _PLUS[p], begin)
            minima = mix(minima)
            keys = np.zeros((len(some), BANDS), np.uint64)
            for b in range(BANDS):
                key = np.full(len(some), b + 1, np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(31) + minima[:, b * ROWS + r])
                keys[:, b] = key
            lanes = 64 // BITS
            low = (minima & np.uint64(2**BITS - 1)).reshape(len(some), ROWS * BANDS // lanes, lanes)
            packed = np.bitwise_or.reduce(low << (np.arange(lanes, dtype=np.uint64) * np.uint64(BITS)), axis=2)
            ends = lambda width: pa.array(np.concatenate([[0], np.cumsum((size > 0) * width)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_key").slice(i, n),
                    batch.column("doc_id").slice(i, n),
                    pa.array(size),
                    *(pa.array(x.view(np.int64)) for x in prints),
                    pa.ListArray.from_arrays(ends(BANDS), pa.array(keys.ravel().view(np.int64))),
                    pa.ListArray.from_arrays(ends(packed.shape[1]), pa.array(packed.ravel().view(np.int64))),
                ],
                ["row_key", "doc_id", "n_shingles", "f1", "f2", "bands", "sig"],
            )


_SIGNATURES = "row_key long, doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, at in chunks(batch.column("text")):
            doc, shingle = _distinct(*_shingles(data, at), j - i)
            ends = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(shingle.view(np.int64)))], ["node", "shingles"])


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its shingles, of the nodes that are wanted; stored."""
    places = nodes.select("node", "row_key").join(wanted, "node").select("row_key", F.col("node").alias("doc_id"), "node")
    texts = on_key(docs, places, "inner")
    return materialize(texts.select("node", "text").mapInArrow(_sets, "node long, shingles array<long>"), "sets", WIDE)


def estimated_similarity(a: Column, b: Column) -> Column:
    """Of two packed signatures: the share of equal lanes, corrected for equal bits by chance."""
    lanes = ROWS * BANDS
    odd = F.lit(0x5555555555555555)
    differ = F.lit(0)
    for k in range(lanes * BITS // 64):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
    chance = 1 / 2**BITS
    return ((lanes - differ) / lanes - chance) / (1 - chance)


def _confirm(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that are links, on their full sets."""
    a = nodes.select(F.col("node").alias("u"), F.col("sig").alias("sig_u"), F.col("n_shingles").alias("n_u"))
    b = nodes.select(F.col("node").alias("v"), F.col("sig").alias("sig_v"), F.col("n_shingles").alias("n_v"))
    likely = (
        pairs.join(b, "v")
        .join(a, "u")
        .where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * LEAST_PERCENT)  # else no intersection is large enough
        .where(estimated_similarity(F.col("sig_u"), F.col("sig_v")) >= LEAST_ESTIMATE)
        .select("u", "v", "n_u", "n_v")
    )
    both = likely.join(sets.withColumnsRenamed({"node": "v", "shingles": "set_v"}), "v").join(sets.withColumnsRenamed({"node": "u", "shingles": "set_u"}), "u")
    common = F.size(F.array_intersect("set_u", "set_v"))
    return both.withColumn("common", common).where(F.col("common") * 100 >= (F.col("n_u") + F.col("n_v") - F.col("common")) * LEAST_PERCENT).select("u", "v")


def _compare_group(group: pa.Table) -> pa.Table:
    """The links (u, v) between asked rows and rows of another component of their cluster."""
    group = group.combine_chunks()
    role, node, label, cluster, size = (group[c].to_numpy() for c in ("asked", "node", "label", "cluster", "n_shingles"))
    sig = group["sig"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
    sets = group["shingles"].combine_chunks()
    ends, shingle = sets.offsets.to_numpy(), sets.values.to_numpy()
    asked, rest = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
    lanes, chance = ROWS * BANDS, 1 / 2**BITS
    found_u, found_v = [], []
    for q in asked:
        x = sig[rest] ^ sig[q]
        differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
        near = ((lanes - differ) / lanes - chance) / (1 - chance) >= LEAST_ESTIMATE
        near &= (cluster[rest] == cluster[q]) & (label[rest] != label[q])
        near &= np.minimum(size[rest], size[q]) * 100 >= np.maximum(size[rest], size[q]) * LEAST_PERCENT
        likely = rest[near]
        if not len(likely):
            continue
        width = ends[likely + 1] - ends[likely]
        own = shingle[ends[q] : ends[q + 1]]
        where = np.arange(width.sum()) + np.repeat(ends[likely] - np.cumsum(width) + width, width)
        common = np.bincount(np.repeat(np.arange(len(likely)), width), np.isin(shingle[where], own), len(likely))
        linked = likely[common * 100 >= (size[likely] + size[q] - common) * LEAST_PERCENT]
        found_u += [node[q]] * len(linked)
        found_v += node[linked].tolist()
    return pa.table({"u": pa.array(found_u, pa.int64()), "v": pa.array(found_v, pa.int64())})


def _compare_clusters(clusters: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The links between different components of a cluster of buckets.

    In every cluster the nodes outside its largest component are asked against all its nodes, in
    blocks: an asked block and a block of the others make one group. Small clusters share groups.
    """
    placed = materialize(clusters.join(labels, "node"), "clustered", NARROW)
    per_label = placed.join(nodes.select("node", "n_shingles"), "node").groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    sizes = per_label.groupBy("cluster").agg(F.sum("n").alias("all"), F.sum("w").alias("weight"), F.max(F.struct("n", "label", "w")).alias("largest"))
    sizes = sizes.select("cluster", "all", "weight", (F.col("all") - F.col("largest.n")).alias("questions"), (F.col("weight") - F.col("largest.w")).alias("asked_weight"), F.col("largest.label").alias("main"))
    sizes = materialize(sizes.where("questions > 0"), "cluster-sizes", NARROW)
    apart = (F.col("all") >= ASKED_BLOCK) | (F.col("weight") >= BLOCK_SHINGLES // 8)
    small = sizes.where(~apart).agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    bins = max(1, -(-small[0] // OTHERS_BLOCK), -(-small[1] // BLOCK_SHINGLES))
    blocks = lambda n, most, w: F.when(apart, F.greatest(F.ceil(F.col(n) / most), F.ceil(F.col(w) / BLOCK_SHINGLES))).otherwise(1).cast("int")
    known = placed.join(sizes, "cluster").select(
        "*",
        F.when(apart, F.col("cluster")).otherwise(-1 - F.pmod(F.xxhash64("cluster"), F.lit(bins))).alias("place"),
        blocks("questions", ASKED_BLOCK, "asked_weight").alias("asked_blocks"),
        blocks("all", OTHERS_BLOCK, "weight").alias("other_blocks"),
    )
    keep = ["node", "label", "cluster", "place"]
    asked_block, other_block = F.pmod(F.xxhash64("node"), "asked_blocks").cast("int"), F.pmod(F.xxhash64(F.lit(1), "node"), "other_blocks").cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    questions = known.where("label <> main").select(*keep, F.lit(1).alias("asked"), asked_block.alias("a"), to("other_blocks").alias("b"))
    others = known.select(*keep, F.lit(0).alias("asked"), to("asked_blocks").alias("a"), other_block.alias("b"))
    rows = questions.unionByName(others).join(nodes, "node").join(sets, "node")
    return rows.groupBy("place", "a", "b").applyInArrow(_compare_group, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    docs = keyed(docs, id_col, text_col)
    rows = materialize(docs.mapInArrow(_signatures, _SIGNATURES), "signatures")
    same = ["f1", "f2", "n_shingles"]
    nodes = materialize(
        rows.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "row_key")).alias("r"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).select(*same, F.col("r.doc_id").alias("node"), "r.row_key", "bands", "sig"),
        "nodes",
        WIDE,
    )
    star_rows = nodes.select("node", F.explode(F.slice("bands", 1, STAR_BANDS)).alias("key"))
    centers = materialize(star_rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("center")).where("n > 1").select("key", "center"), "centers", NARROW)
    stars = materialize(star_rows.join(centers, "key").where("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct(), "stars", NARROW)
    compared = materialize(stars.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "compared", NARROW)
    sets = _sets_of(docs, nodes, compared)
    brief = nodes.select("node", "sig", "n_shingles")
    links = materialize(_confirm(stars, brief, sets), "links", NARROW)
    labels = nodes.select("node", "bands").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Buckets of all bands in which several components meet, chained to clusters.
    met = labels.select("node", "label", F.explode("bands").alias("key")).groupBy("key").agg(F.min("node").alias("u"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    mixed = materialize(met.where("l0 <> l1").select("key", "u"), "mixed-buckets", NARROW)
    spread = nodes.select("node", F.explode("bands").alias("key"))
    chains = spread.join(mixed, "key").select("u", F.col("node").alias("v")).distinct()
    clusters = components(chains).select("node", F.col("label").alias("cluster"))
    late = materialize(clusters.select("node").join(compared, "node", "left_anti"), "late", NARROW)
    sets = sets.unionByName(_sets_of(docs, nodes, late))
    more = materialize(_compare_clusters(clusters, labels.select("node", "label"), brief, sets), "more-links", NARROW)
    final = components(links.unionByName(more))
    named = materialize(nodes.select(*same, "node").join(final, "node", "left").select(*same, F.coalesce("label", "node").alias("component_id")), "named", NARROW)
    out = rows.select("doc_id", *same).join(named, same, "left")
    whole = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), whole)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of documents that another one of their component stands for."""
    gone = materialize(near_duplicates(docs, id_col, text_col).where("not kept").select("doc_id").distinct(), "gone", NARROW)
    return docs.join(gone, docs[id_col] == gone["doc_id"], "left_anti")
