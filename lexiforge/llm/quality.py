"""Quality rules: how much of a text repeats itself, by rolling hashes.

For every document the share of characters inside repeated word n-grams (of
several lengths) and inside repeated lines is measured exactly over the whole
text. Of equal n-grams or lines all but the first count as repeated.
The hashes of all n-grams of a batch come from two prefix sums; an n-gram
can only repeat where its first n-1 words do, so each longer length looks only
at what the shorter one left.

Defined results: a null or empty text has zero words and fails the base rule;
repeated rows are each measured; texts are read whole however long (a chunk of work holds one text at least);
extra columns are ignored by ``measure`` and
passed through by ``filter_quality``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.rolling import Words, chunks, mix

#: The most of a text's word characters, in percent, that repeated stretches may cover.
TOP_NGRAM_PERCENT = {2: 20, 3: 18, 4: 16}
DUPLICATE_NGRAM_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
DUPLICATE_LINE_PERCENT = 30
DUPLICATE_LINE_CHARS_PERCENT = 20
LEAST_DUPLICATE_LINES = 2  # a page's heading that its foot repeats breaks no rule
LEAST_WORDS = 50
REPEAT_WORDS_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

COUNTS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "dup_line_chars",
    "n_repeat_words",
    *(f"top_{n}_chars" for n in TOP_NGRAM_PERCENT),
    *(f"dup_{n}_chars" for n in DUPLICATE_NGRAM_PERCENT),
]
SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it is there more than once, and whether it is there before."""
    if not len(keys):
        return np.empty(0, bool), np.empty(0, bool)
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    again, before = np.empty(len(keys), bool), np.empty(len(keys), bool)
    again[order] = same[:-1] | same[1:]
    before[order] = same[:-1]
    return again, before


def _inside(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words from one of the starts."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + size, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n).astype(np.int64)


def measure_chunk(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each document of a chunk."""
    n = len(at) - 1
    words = Words(data, at)
    doc = words.doc
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[words.end] - points[words.start]
    out = {"n_words": np.bincount(doc, minlength=n).astype(np.int64), "word_chars": _per_doc(chars, doc, n)}
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out["n_symbols"] = symbols[at[1:]] - symbols[at[:-1]]

    # Lines with a word: each begins at a document's start or after a line feed.
    feed = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([at[:-1][at[:-1] < at[1:]], feed + 1]))
    begin = begin[begin < len(data)]
    line_doc = np.searchsorted(at, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], len(data)), at[line_doc + 1])
    end -= (end > begin) & (data[np.maximum(end - 1, 0)] == 10)
    full = np.searchsorted(words.start, begin) < np.searchsorted(words.start, end)
    begin, end, line_doc = begin[full], end[full], line_doc[full]
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    key = mix(words.sums.stretch(begin, end) + (end - begin).astype(np.uint64)) ^ salt[line_doc]
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[first] = False
    out["n_lines"] = np.bincount(line_doc, minlength=n).astype(np.int64)
    out["n_dup_lines"] = _per_doc(later, line_doc, n)
    before = np.concatenate([[0], np.cumsum(chars)])
    line_chars = before[np.searchsorted(words.start, end)] - before[np.searchsorted(words.start, begin)]
    out["dup_line_chars"] = _per_doc(line_chars * later, line_doc, n)

    # n-grams, shortest first; ``at_word``: where the n-gram's first n-1 words repeat.
    sums = words.sequence()
    at_word = np.flatnonzero(words.inside(2))
    for size in range(2, 1 + max(DUPLICATE_NGRAM_PERCENT)):
        at_word = at_word[at_word + size <= len(doc)]
        at_word = at_word[doc[at_word] == doc[at_word + size - 1]]
        key = mix(sums.stretch(at_word, at_word + size)) ^ salt[doc[at_word]]
        again, before_it = _repeated(key)
        later_copies = at_word[before_it]
        at_word, key = at_word[again], key[again]
        if size in TOP_NGRAM_PERCENT:
            # the most frequent n-gram of a document; of equally frequent ones the longest in characters
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            where = at_word[first]
            covered = count * (before[where + size] - before[where])
            order = np.lexsort((covered, count, doc[where]))
            top = np.zeros(n, np.int64)
            top[doc[where][order]] = covered[order]
            out[f"top_{size}_chars"] = top
        if size == 3 or size in DUPLICATE_NGRAM_PERCENT:
            if size == 3:
                out["n_repeat_words"] = _per_doc(_inside(at_word, size, len(doc)), doc, n)
            else:
                out[f"dup_{size}_chars"] = _per_doc(chars * _inside(later_copies, size, len(doc)), doc, n)
    return out


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        for i, j, data, at in chunks(text):
            counts = measure_chunk(data, at)
            rest = batch.slice(i, j - i)
            columns = [rest.column(k) for k, name in enumerate(batch.schema.names) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(counts[c], pa.int64()) for c in COUNTS], names + COUNTS)


def _clean(c):
    """Whether no rule of repetition is broken; ``c`` gives the column or array of a count."""
    ok = (c("n_dup_lines") < LEAST_DUPLICATE_LINES) | (c("n_dup_lines") * 100 <= c("n_lines") * DUPLICATE_LINE_PERCENT)
    ok &= c("dup_line_chars") * 100 <= c("word_chars") * DUPLICATE_LINE_CHARS_PERCENT
    for kind, limits in (("top", TOP_NGRAM_PERCENT), ("dup", DUPLICATE_NGRAM_PERCENT)):
        for n, most in limits.items():
            ok &= c(f"{kind}_{n}_chars") * 100 <= c("word_chars") * most
    return ok


def _base_failed(c):
    return (c("n_words") < LEAST_WORDS) | (c("n_repeat_words") * 100 > c("n_words") * REPEAT_WORDS_PERCENT)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the counts, base_failed and kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_measure_batches, f"doc_id long, {SCHEMA}")
    return out.withColumn("base_failed", _base_failed(F.col)).withColumn("kept", ~F.col("base_failed") & _clean(F.col))


def filter_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; no shuffle.

    A document is measured and filtered in the task that reads it.
    """
    place = docs.columns.index(text_col)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in chunks(batch.column(place)):
                counts = measure_chunk(data, at).__getitem__
                keep = _clean(counts) & ~_base_failed(counts)
                if keep.any():
                    yield batch.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(passing, docs.schema)
