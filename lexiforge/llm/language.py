"""Language identification in two steps: the family first, then linear support vector machines between two languages of it.

Texts are read as frequencies of hashed n-grams of 1 to 4 bytes (A-Z in lower case, other ASCII but letters as one space).
One machine for each family tells it from the others; within the family with the largest margin, one machine for each pair
of its languages votes. Each machine is fitted by dual coordinate descent in a Spark task of its own, on a bounded sample:
the ``rows_per_lang`` distinct labelled texts of each language with the least hashes (of which the machines of the families see
``family_rows``). Predictions then read every whole text once, in Arrow batches; the model is (families + pairs) x 2^14 numbers.

Families are those of ``FAMILIES``; a label that is not in it is a family of its own. More than ``MOST_LANGS`` labels raise an error.

``score`` is the family's share of the softmax over margins, times the mean logistic margin of the winner's pairs.

Defined results: a null text or one without a letter is ``und`` with score 0; so is everything if there is nothing to learn from; a
null id is read as an empty one, whose row is held out; rows that are equal get equal predictions, and copies are learned from
once; votes that tie go to the larger sum of margins; texts are read whole however long (a chunk of work holds one text at
least); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import WorkTable
from lexiforge.llm.rolling import chunks

#: Codes of languages by family; part of the method, a parameter of ``identify``.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt",
    "indic": "hi bn ur mr ne pa gu",
}
#: Distinct texts of a language that its pairs are fitted on, those of them that families are fitted on, and labels at most.
ROWS_PER_LANG, FAMILY_ROWS, MOST_LANGS = 600, 200, 1000
BITS, LONGEST = 14, 4
#: The range of hashes is counted in 2^PART_BITS parts to find the least ones.
PART_BITS = 10
_BYTE = np.arange(256, dtype=np.uint32)
_BYTE[ord("A") : ord("Z") + 1] += 32
_BYTE[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams: the document and the hash of each, in order of documents."""
    b = _BYTE[data]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    blank = b == 0x20
    code = np.zeros(len(b), np.uint32)
    for n in range(1, LONGEST + 1):
        k = max(0, len(b) - n + 1)
        code = code[:k] | b[n - 1 :] << np.uint32(8 * (n - 1))
        # within one document, and not from one space to the next
        good = (doc[:k] == doc[n - 1 :]) & ~(blank[:k] & (blank[1 : k + 1] if n > 1 else True))
        yield doc[:k][good], (code[good] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, key, and frequencies of the n-grams of each text."""
    for batch in batches:
        for i, j, data, at in chunks(batch.column("text")):
            both = [np.concatenate(x) for x in zip(*grams(data, at), strict=True)]
            cell, n = np.unique(both[0] << BITS | both[1], return_counts=True)
            doc = cell >> BITS
            ends = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
            share = n / np.bincount(doc, n, j - i)[doc]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((cell & (1 << BITS) - 1).astype(np.int32), share.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), batch.column("key").slice(i, j - i), *lists], ["lang", "key", "gram", "share"])


def fit_machine(grams_of: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, rounds: int = 30, penalty: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (hinge loss, both sides weighing the same), by dual coordinate descent."""
    scale = 1 / np.sqrt(np.mean([s @ s for s in shares]))
    rows = [(g, s.astype(np.float64) * scale) for g, s in zip(grams_of, shares, strict=True)]
    most = np.where(y > 0, penalty * len(y) / (2 * max(1, (y > 0).sum())), penalty * len(y) / (2 * max(1, (y < 0).sum())))
    norm = [s @ s + 1 for _, s in rows]
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(13)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g, s = rows[i]
            new = min(max(alpha[i] - (y[i] * (w[g] @ s + bias) - 1) / norm[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[g] += step * s
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w * scale, bias


def _fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["key", "lang"])
    w, bias = fit_machine(list(rows["gram"]), list(rows["share"]), rows["y"].to_numpy())
    return pd.DataFrame({"machine": [key[0]], "w": [w.astype(np.float32)], "bias": [bias]})


class Identifier:
    """Families (name and its languages), and of each machine the weights by n-gram and the bias."""

    def __init__(self, families: dict[str, list[str]], machines: dict[str, tuple[np.ndarray, float]]):
        self.names = sorted(families)
        self.langs = [families[f] for f in self.names]
        stack = lambda keys: (np.stack([machines[k][0] for k in keys], axis=1), np.array([machines[k][1] for k in keys])) if keys else None
        self.top = stack([f"family {f}" for f in self.names]) if len(self.names) > 1 else None
        self.pairs = [list(combinations(range(len(langs)), 2)) for langs in self.langs]
        self.within = [stack([f"pair {langs[a]}\x1f{langs[b]}" for a, b in pairs]) for langs, pairs in zip(self.langs, self.pairs, strict=True)]

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[list[str | None], np.ndarray]:
        """Language (None without an n-gram) and score of each text."""
        n = len(at) - 1
        found = list(grams(data, at))
        size = sum((np.bincount(doc, minlength=n) for doc, _ in found), np.zeros(n, np.int64))
        score = np.where(size > 0, 1.0, 0.0)
        family = np.zeros(n, np.int64)
        if self.top:
            margin = _margins(found, size, self.top)
            family = margin.argmax(axis=1)
            e = np.exp(margin - margin.max(axis=1, keepdims=True))
            score *= e.max(axis=1) / e.sum(axis=1)
        lang: list[str | None] = [None] * n
        for f, langs in enumerate(self.langs):
            mine = np.flatnonzero((family == f) & (size > 0))
            if not len(mine):
                continue
            best = np.zeros(len(mine), np.int64)
            if self.within[f]:
                place = np.full(n, -1)
                place[mine] = np.arange(len(mine))
                margin = _margins([(place[doc[place[doc] >= 0]], h[place[doc] >= 0]) for doc, h in found], size[mine], self.within[f])
                votes, total, sure = (np.zeros((len(mine), len(langs))) for _ in range(3))
                for k, (a, b) in enumerate(self.pairs[f]):
                    for lang_no, m in ((a, margin[:, k]), (b, -margin[:, k])):
                        votes[:, lang_no] += m > 0
                        total[:, lang_no] += m
                        sure[:, lang_no] += 1 / (1 + np.exp(-2 * np.clip(m, -50, 50)))
                best = np.lexsort((total, votes), axis=1)[:, -1]
                score[mine] *= sure[np.arange(len(mine)), best] / (len(langs) - 1)
            for d, k in zip(mine, best, strict=True):
                lang[d] = langs[k]
        return lang, np.round(score, 6)


def _margins(found: list[tuple[np.ndarray, np.ndarray]], size: np.ndarray, machine: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each document and machine."""
    w, bias = machine
    total = np.zeros((len(size), len(bias)))
    for doc, h in found:
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
        if len(first):
            for k in range(len(bias)):
                total[doc[first], k] += np.add.reduceat(w[:, k][h], first, dtype=np.float64)
    return total / np.maximum(size, 1)[:, None] + bias


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, rows_per_lang: int) -> DataFrame:
    """lang, key (a hash) and text of the texts to learn from; ``docs``: lang, text."""
    keyed = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("key", F.xxhash64("text"))
    keys = WorkTable(keyed.select("lang", "key").distinct(), "language-keys").df.withColumn("part", F.shiftright("key", 64 - PART_BITS))
    # the lowest parts of the range of hashes that hold enough of a language
    sizes = keys.groupBy("lang", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low = sizes.withColumn("before", before).where(F.col("before") < rows_per_lang).select("lang", "part")
    by = Window.partitionBy("lang").orderBy("key")
    picked = keys.join(low, ["lang", "part"]).select("lang", "key").withColumn("place", F.row_number().over(by)).where(F.col("place") <= rows_per_lang)
    picked = WorkTable(picked, "language-sample", 100_000)
    # copies of a picked text become one where they lie
    return keyed.join(picked.df, ["lang", "key"]).groupBy("lang", "key").agg(F.any_value("text").alias("text"))


def fit_identifier(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, family_rows: int = FAMILY_ROWS, families: dict[str, str] | None = None) -> Identifier | None:
    """Learns from ``docs`` (lang, text); None if there is nothing to learn from."""
    of = {code: f for f, codes in (FAMILIES if families is None else families).items() for code in codes.split()}
    rows = WorkTable(labelled_sample(docs, rows_per_lang).select("lang", "key", "text").mapInArrow(_features, "lang string, key long, gram array<int>, share array<float>"), "language-features").df
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGS + 1).collect())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not langs:
        return None
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(of.get(lang.lower().replace("_", "-").split("-")[0], f"only {lang}"), []).append(lang)
    # the machines that a language's rows go to, with their side
    to = []
    for f, own in members.items():
        to += [(lang, f"family {f}", 1 if lang in own else -1) for lang in langs if len(members) > 1]
        to += [(lang, f"pair {a}\x1f{b}", y) for a, b in combinations(own, 2) for lang, y in ((a, 1), (b, -1))]
    machines = {}
    if to:
        table = rows.sparkSession.createDataFrame(to, "lang string, machine string, y int")  # a row for each language and machine
        near = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
        dealt = rows.withColumn("place", near).join(F.broadcast(table), "lang").where(F.col("machine").startswith("pair ") | (F.col("place") <= family_rows))
        fitted = dealt.select("machine", "lang", "key", "y", "gram", "share").groupBy("machine").applyInPandas(_fit, "machine string, w array<float>, bias double")
        machines = {r["machine"]: (np.array(r["w"], np.float32), r["bias"]) for r in fitted.collect()}  # the model
    return Identifier(members, machines)


def _predictor(model: Identifier | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in chunks(batch.column("text")):
                lang, score = model.predict(data, at) if model else ([None] * (j - i), np.zeros(j - i))
                said = ["und" if x is None else x for x in lang]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array(said, pa.string()), pa.array(score)], names)

    names = ["doc_id", "held_out", "lang_pred", "score"]
    return run


def identify(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, family_rows: int = FAMILY_ROWS, families: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; learned from those that are not held out."""
    text = F.col(text_col).cast("string")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(lang_col).cast("string").alias("lang"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    model = fit_identifier(plain.where(~F.col("held_out")).select("lang", "text"), rows_per_lang, family_rows, families)
    return plain.select("doc_id", "held_out", "text").mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")
