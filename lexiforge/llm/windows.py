"""Runs of equal-length windows that share an anchor, and the spans they cover.

A window is ``length`` consecutive units (bytes or words) of one document. Its
anchor is the least hash of the ``k``-unit pieces inside it, so equal windows
have equal anchors at equal places. Consecutive windows with the same anchor
form a run; a text has a run for every 5 words or 185 bytes. Windows can only
be equal if their runs have the same anchor hash, so what is
unique there needs no closer look, and runs of equal content are settled as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import on_key
from lexiforge.llm.rolling import Words, byte_sums, chunks, least_in_windows, mix

RUN_SCHEMA = "row_key long, doc_id long, h long, c long, d int, s int, m int"
SPANS = "array<struct<s:int,e:int>>"


def _runs_of_chunk(data: np.ndarray, at: np.ndarray, unit: str, length: int, k: int):
    """Document, anchor hash, content hash, distance to the anchor, first window and number of windows of each run."""
    if unit == "word":
        words = Words(data, at)
        sums, doc, inside = words.sequence(), words.doc, words.inside(length)
        first = words.first
    else:
        sums, doc = byte_sums(data), np.repeat(np.arange(len(at) - 1), np.diff(at))
        inside = doc[: max(0, len(doc) - length + 1)] == doc[length - 1 :]
        first = at[:-1]
    pieces = mix(sums.windows(k))
    anchor = least_in_windows(pieces, length - k + 1)
    n = len(anchor)
    if not n:
        return None
    edge = np.ones(n, bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:n] != doc[: n - 1])
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    start, end = start[inside[start]], end[inside[start]]
    d = anchor[start] - start
    content = mix(sums.stretch(start, end - 1 + length) + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (end - start).astype(np.uint64))
    of = doc[start]
    return of, pieces[anchor[start]].view(np.int64), content.view(np.int64), d, start - first[of], end - start


def runs(docs: DataFrame, unit: str, length: int, k: int) -> DataFrame:
    """The runs of all windows of ``docs`` (row_key, doc_id, text), RUN_SCHEMA."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, data, at in chunks(batch.column("text")):
                found = _runs_of_chunk(data, at, unit, length, k)
                if found is None:
                    continue
                of, h, c, d, s, m = found
                rows = pa.array(of + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_key").take(rows), batch.column("doc_id").take(rows), pa.array(h), pa.array(c), pa.array(d.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(m.astype(np.int32))],
                    ["row_key", "doc_id", "h", "c", "d", "s", "m"],
                )

    return docs.mapInArrow(batches, RUN_SCHEMA)


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"))


def lists_by_row(rows: DataFrame, item: Column, name: str) -> DataFrame:
    """row_key, doc_id and the list of its items: at most as many as the document has windows."""
    return rows.groupBy("row_key", "doc_id").agg(F.collect_list(item).alias(name))


def flat_list(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of rows i to j: the row (from 0) of each item of a list of structs, and the items' fields; null lists are empty."""
    part = column.slice(i, j - i)
    lengths = np.nan_to_num(pa.compute.list_value_length(part).to_numpy(zero_copy_only=False)).astype(np.int64)
    items = part.flatten()
    return np.repeat(np.arange(j - i), lengths), {f.name: items.field(f.name).to_numpy(zero_copy_only=False) for f in items.type}


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` units lie in one of the spans."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _digests(data: np.ndarray, keep: np.ndarray, at: np.ndarray) -> list[str]:
    """SHA-256 of the kept bytes of each document."""
    total = np.concatenate([[0], np.cumsum(keep)])
    kept = data[keep].tobytes()
    bounds = total[at]
    return [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def cut(docs: DataFrame, spans: DataFrame, unit: str, text: bool = False) -> DataFrame:
    """Every document once: sizes, removed units and runs, digest (and text) of what is left.

    ``spans``: row_key, doc_id, span; each span (in units) is removed. Words that are kept are joined by one space.
    """
    listed = lists_by_row(spans, F.col("span"), "spans")
    joined = on_key(docs, listed, "left")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            column = batch.column("spans")
            for i, j, data, at in chunks(batch.column("text")):
                row, item = flat_list(column, i, j)
                if unit == "word":
                    words = Words(data, at)
                    gone = covered(words.first[row] + item["s"], words.first[row] + item["e"], len(words.doc))
                    n, removed = np.bincount(words.doc, minlength=j - i), np.bincount(words.doc, gone, j - i)
                    pieces = np.bincount(words.doc, gone & ~np.concatenate([[False], gone[:-1] & (words.doc[1:] == words.doc[:-1])]), j - i)
                    keep = np.bincount(words.start[~gone], minlength=len(data) + 1) - np.bincount(words.end[~gone], minlength=len(data) + 1)
                    keep = np.cumsum(keep[: len(data)]) > 0
                    left, owner = words.end[~gone], words.doc[~gone]
                    follows = left[:-1][owner[:-1] == owner[1:]]  # the byte after a kept word that has another after it
                    data = data.copy()
                    data[follows] = 0x20
                    keep[follows] = True
                else:
                    gone = covered(at[row] + item["s"], at[row] + item["e"], len(data))
                    doc = np.repeat(np.arange(j - i), np.diff(at))
                    n, removed = np.diff(at), np.bincount(doc, gone, j - i)
                    pieces = np.bincount(doc, gone & ~np.concatenate([[False], gone[:-1] & (doc[1:] == doc[:-1])]), j - i)
                    keep = ~gone
                out = [batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(pieces.astype(np.int64)), pa.array(_digests(data, keep, at))]
                names = ["doc_id", f"n_{unit}s", "n_removed", "n_spans", "kept_sha256"]
                if text:
                    total = np.concatenate([[0], np.cumsum(keep)])[at]
                    kept = data[keep].tobytes()
                    out.append(pa.array([kept[a:b].decode("utf-8", "replace") for a, b in zip(total[:-1], total[1:], strict=True)], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc_id long, n_{unit}s long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * text
    return joined.select("doc_id", "text", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")).mapInArrow(batches, schema)
