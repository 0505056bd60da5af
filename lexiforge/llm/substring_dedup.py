"""Substring dedup: words inside a window that an earlier document has too.

Rabin-Karp hashes of all windows of ``length`` words are counted in Spark. They
are counted as runs of windows first (see ``windows``): where all runs with an
anchor have one content, its least document settles all its windows at once;
only runs whose anchor has several contents are split into single windows,
and of these only one run for each content. Repeated windows merge into maximal
intervals, which are removed.

A word is removed if a window over it also starts in a document with a smaller
doc_id. Defined results: a null or empty text has no words; texts shorter than a
window lose nothing; rows with equal doc_id are one document; a null doc_id is
smaller than none and has none smaller; texts are read whole however long (a chunk of work holds one text at least); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import keyed, materialize, on_key
from lexiforge.llm.rolling import Words, chunks, mix
from lexiforge.llm.windows import cut, flat_list, lists_by_row, runs, span

LENGTH = 13
PIECE = 5


def _single_windows(docs: DataFrame, open_runs: DataFrame, length: int) -> DataFrame:
    """row_key, doc_id, h, w (hash of a window), s of every window of the runs."""
    listed = lists_by_row(open_runs, F.struct("h", "s", "m"), "runs")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, data, at in chunks(batch.column("text")):
                row, item = flat_list(batch.column("runs"), i, j)
                words = Words(data, at)
                each = np.repeat(np.arange(len(row)), item["m"])
                step = np.arange(len(each)) - np.repeat(np.cumsum(item["m"]) - item["m"], item["m"])
                s = item["s"][each] + step
                place = words.first[row[each]] + s
                w = mix(words.sequence().stretch(place, place + length))
                rows = pa.array(row[each] + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_key").take(rows), batch.column("doc_id").take(rows), pa.array(item["h"][each]), pa.array(w.view(np.int64)), pa.array(s.astype(np.int32))],
                    ["row_key", "doc_id", "h", "w", "s"],
                )

    return on_key(docs, listed, "inner").select("row_key", "doc_id", "text", "runs").mapInArrow(batches, "row_key long, doc_id long, h long, w long, s int")


def removal_spans(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """row_key, doc_id and span (words from s to before e) of what is to go."""
    found = materialize(runs(docs, "word", length, piece), "word-runs")
    anchors = found.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    shared = materialize(anchors.where("lo < hi").select("h", "lo", (F.col("c0") != F.col("c1")).alias("mixed")), "shared-anchors")
    closer = materialize(
        found.join(shared, "h").where("mixed or doc_id > lo").select("row_key", "doc_id", "h", "c", "s", "m", "mixed"),
        "shared-runs",
    )
    whole = span(F.col("s"), F.col("s") + F.col("m") - 1 + length).alias("span")
    settled = closer.where("not mixed").select("row_key", "doc_id", whole)
    mixed = closer.where("mixed")
    least = materialize(mixed.groupBy("h", "c").agg(F.min("doc_id").alias("first")), "contents")
    told = materialize(mixed.join(least, ["h", "c"]), "mixed-runs")
    later = told.where("doc_id > first").select("row_key", "doc_id", whole)
    # Of each content, the runs of its first document stand for all.
    single = materialize(_single_windows(docs, told.where("doc_id = first").select("row_key", "doc_id", "h", "s", "m"), length), "single-windows")
    first = materialize(single.groupBy("h", "w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "w", "lo"), "first-windows")
    again = single.join(first, ["h", "w"]).where("doc_id > lo").select("row_key", "doc_id", span(F.col("s"), F.col("s") + length).alias("span"))
    return settled.unionByName(later).unionByName(again)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 (and kept_text) of each document."""
    docs = keyed(docs, id_col, text_col)
    return cut(docs, removal_spans(docs, length, piece), "word", text)
