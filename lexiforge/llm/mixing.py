"""Soft-membership mixing: rates that bring expected domain token totals to their targets.

A softmax regression on the presence of telling words and beginnings of words (chosen by chi-squared; beginnings
tell in languages whose telling words are each rare), fitted on a bounded sample of labelled rows, gives every document its posterior over the domains ``high``,
``low`` (quality 1 and 0) and ``toxic``. Projected gradient descent then fits
a nonnegative rate for each document so that the rates times tokens times
posteriors, summed by domain, meet the targets. The squares are weighted by the inverse of
the domains' Gram matrix, so a step of 1 is the right one however rare a domain
is. An iteration is one aggregate over a narrow table; only three sums and
the model reach the driver.

The fit ends at its targets, or where steps no longer bring it nearer (a step that leads away is halved): targets that
no rates from ``least`` to ``MOST_RATE`` can meet are met as nearly as they can be, by the plain sum of squares. A wanted domain that hardly any
document has (``LEAST_SHARE``) has no target, and the others share its weight.

Defined results: a null or empty text has 0 tokens and the model's prior; labels with nulls are skipped, of repeated labels of
a document the largest counts; a domain that no label names has posterior 0, but without any label all domains are equally likely;
if no domain with a target has tokens, documents that are rather toxic have rate 0 and all others 1; texts are read whole however
long (a chunk of work holds one text at least); repeated rows and null ids are documents like any other; other columns are
ignored by ``fit_rates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import free_name, keyed, materialize, on_key, row_key
from lexiforge.llm.rolling import MARKS, Words, chunks, mix

DOMAINS = ("high", "low", "toxic")
#: The most labelled rows that the classifier is fitted on, and the most words and beginnings that it knows.
SAMPLE_ROWS, VOCABULARY = 20_000, 2048
#: Words and beginnings in fewer documents of the sample are left out.
LEAST_DOCUMENTS = 3
#: Bytes that the beginnings of words have.
BEGINNINGS = range(3, 9)
#: The fit ends when every total is this near its target, as a share of all tokens.
TOLERANCE = 0.002
#: The most rounds of a fit, and the most of them one after the other that gain less than 2 in 1,000.
MOST_ITERATIONS, MOST_IDLE = 200, 5
#: The greatest rate of a document.
MOST_RATE = 64.0
#: The share of all tokens that a domain needs to have a target.
LEAST_SHARE = 1e-6
#: Of the hash that rounds rates to copies.
SEED = 6


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and domain (number) of at most ``rows`` labelled documents, by the order of a hash of the id.

    Labels of ids that are not here take no place; of rows with one id the one with the least hash of the text stands for all.
    """
    one = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.struct("toxic", "quality")).alias("l"))
    domain = F.when(F.col("l.toxic") == 1, 2).when(F.col("l.quality") == 1, 0).otherwise(1)
    docs = keyed(docs)
    keys = docs.groupBy("doc_id").agg(F.min("row_key").alias("row_key")).join(one.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")), "doc_id")
    picked = keys.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = on_key(docs, F.broadcast(picked), "inner")  # at most ``rows`` rows
    return found.dropDuplicates(["doc_id"]).select("text", "domain")


def _features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document; document and hash of its words, in lower case, with and without punctuation, and of their beginnings."""
    words, bare = Words(data, at, lower=True), Words(data, at, lower=True, space=MARKS)
    n = np.bincount(words.doc, minlength=len(at) - 1).astype(np.int64)
    docs, hashes = [words.doc, bare.doc], [words.hash, bare.hash]
    for k in BEGINNINGS:
        longer = bare.end - bare.start > k
        start = bare.start[longer]
        docs.append(bare.doc[longer])
        # so much added that no whole word of a few hundred bytes has this hash
        hashes.append(mix(bare.sums.stretch(start, start + k) + np.uint64(1000 + k)))
    return n, np.concatenate(docs), np.concatenate(hashes)


def _present(data: np.ndarray, at: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document; document and number of each word of the vocabulary that it has, once."""
    n, doc, h = _features(data, at)
    place = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
    known = vocabulary[place] == h if len(vocabulary) else np.zeros(len(place), bool)
    pair = np.unique(doc[known].astype(np.int64) * max(1, len(vocabulary)) + place[known])
    return n, pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary))


class Classifier:
    """Softmax regression on word presence: sorted word hashes, a weight for each word and domain, a bias for each domain."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias

    def scores(self, doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(doc, self.weights[word, d], n) for d in range(len(DOMAINS))], axis=1) + self.bias

    def posteriors(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, doc, word = _present(data, at, self.vocabulary)
        return n, softmax(self.scores(doc, word, len(n)))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word of a chunk, in how many documents of each domain it is."""
    for batch in batches:
        for i, j, data, at in chunks(batch.column("text")):
            # a word counts once for each document
            _, doc, h = _features(data, at)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            known, at_word = np.unique(h[new], return_inverse=True)
            domain = batch.column("domain").slice(i, j - i).to_numpy()[doc[new]]
            counts = [pa.array(np.bincount(at_word[domain == d], minlength=len(known)).astype(np.int64)) for d in range(len(DOMAINS))]
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), *counts], ["w", *(f"n{d}" for d in range(len(DOMAINS)))])


def fit_classifier(sample: DataFrame, vocabulary: int = VOCABULARY, iterations: int = 200, ridge: float = 1e-3) -> Classifier:
    """Fitted on the rows of ``sample`` (text, domain), which must be bounded; their word numbers are gathered on the driver."""
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    domains = sorted(sizes)
    each = [f"n{d}" for d in range(len(DOMAINS))]
    parts = sample.select("text", "domain").mapInArrow(_word_counts, "w long, " + ", ".join(f"{c} long" for c in each))
    counts = parts.groupBy("w").agg(*(F.sum(c).alias(c) for c in each)).withColumn("n", sum((F.col(c) for c in each), F.lit(0)))
    # Chi-squared of a word's documents by domain against the sample's.
    surprise = F.lit(0.0)
    for d in domains:
        expected = F.col("n") * (sizes[d] / total)
        surprise = surprise + (F.col(f"n{d}") - expected) ** 2 / expected
    telling = counts.where(F.col("n") >= LEAST_DOCUMENTS).withColumn("surprise", F.round(surprise, 6))
    top = telling.orderBy(F.desc("surprise"), "w").limit(vocabulary).collect()  # at most ``vocabulary`` rows
    known = np.sort(np.array([r["w"] for r in top], np.int64).view(np.uint64))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in chunks(batch.column("text")):
                _, doc, word = _present(data, at, known)
                ends = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("domain").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(word.astype(np.int32)))], ["domain", "words"])

    table = sample.select("text", "domain").mapInArrow(features, "domain int, words array<int>").toArrow()  # at most SAMPLE_ROWS rows
    y = table["domain"].to_numpy()
    lists = table["words"].combine_chunks()
    word = lists.flatten().to_numpy()
    doc = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    model = Classifier(known, np.zeros((max(1, len(known)), len(DOMAINS))), np.zeros(len(DOMAINS)))
    if not len(y):
        return model
    hot = np.eye(len(DOMAINS))[y]
    # Full-batch gradient with Adam's step sizes.
    m, v = np.zeros((len(model.weights) + 1, len(DOMAINS))), np.zeros((len(model.weights) + 1, len(DOMAINS)))
    for t in range(1, iterations + 1):
        error = (softmax(model.scores(doc, word, len(y))) - hot) / len(y)
        grad = np.stack([np.bincount(word, error[doc, d], len(model.weights)) for d in range(len(DOMAINS))], axis=1) + ridge * model.weights
        grad = np.vstack([grad, error.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        model.weights -= step[:-1]
        model.bias -= step[-1]
    model.bias[[d for d in range(len(DOMAINS)) if d not in sizes]] = -np.inf
    return model


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """row_key, doc_id, n_tokens and p_<domain> of each document (row_key, doc_id, text)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, data, at in chunks(batch.column("text")):
                n, p = model.posteriors(data, at)
                yield pa.RecordBatch.from_arrays([batch.column("row_key").slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.array(n), *(pa.array(np.round(p[:, d], 9)) for d in range(len(DOMAINS)))], names)

    names = ["row_key", "doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS)]
    return docs.mapInArrow(batches, "row_key long, doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))


def fit_rates(members: DataFrame, weights: dict[str, float] | None = None, tolerance: float = TOLERANCE, most_iterations: int = MOST_ITERATIONS, least: float = 0.0) -> DataFrame:
    """``members`` (n_tokens, p_<domain>; a stored table) with ``rate``.

    ``weights``: of each wanted domain, its share of their tokens; None: what they have now. The targets share out
    what documents hold that are rather not ``toxic``; the target of ``toxic`` is the expectation that these
    documents carry, which no choice of documents could take away.

    ``least``: if above 0, the least rate of documents that are rather not ``toxic``, so that all of them stay. The
    shares are then met by more tokens (every weight must be above 0), and what is rather ``toxic`` has rate 0.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    k = len(DOMAINS)
    stays = F.col("p_toxic") < 0.5
    rather = F.when(stays, F.col("n_tokens")).otherwise(0)
    sums = [F.sum(F.col("n_tokens") * p[a] * p[b]) for a in range(k) for b in range(k)] + [F.sum(rather * c) for c in p]
    row = np.array(members.agg(*(F.coalesce(x, F.lit(0.0)).alias(f"s{i}") for i, x in enumerate(sums))).first(), float)
    gram, want = row[: k * k].reshape(k, k), row[k * k :]
    now = gram.sum(axis=1)  # posteriors sum to 1
    total = now.sum()
    wanted = np.array([d != "toxic" for d in DOMAINS])
    start = F.when(stays, F.lit(max(1.0, least))).otherwise(0.0)
    if total <= 0 or want[wanted].sum() <= 0:
        return members.withColumn("rate", start)
    if weights is not None:
        share = np.array([weights.get(d, 0.0) for d in DOMAINS], float)
        if least > 0 and share[wanted].min() <= 0:
            raise ValueError("a domain of which all documents stay needs a weight above 0")
        wanted &= now > LEAST_SHARE * total
        if share[wanted].sum() <= 0:
            return members.withColumn("rate", start)
        want[wanted] = share[wanted] / share[wanted].sum() * want[wanted].sum()
    fitted = wanted if least > 0 else now > LEAST_SHARE * total  # with ``least`` only the wanted domains
    inverse = np.zeros((k, k))
    inverse[np.ix_(fitted, fitted)] = np.linalg.pinv(gram[np.ix_(fitted, fitted)] / total, rcond=1e-6)
    goal = want / want[wanted].sum()

    def miss_of(rates: DataFrame) -> np.ndarray:
        """How far each domain's tokens are from their target, as a share of all tokens (with ``least``, of those it leads to)."""
        have = np.array(rates.agg(*(F.sum(F.col("rate") * F.col("n_tokens") * c) for c in p)).first(), float)
        if least > 0:
            return np.where(fitted, have / have[wanted].sum() - goal, 0.0)
        return np.where(fitted, have - want, 0.0) / total

    first = members.withColumn("rate", start if least > 0 else F.lit(1.0))
    # Weighted squares reach any target that can be reached; of the others plain squares tell what is nearest.
    plain = np.diag(fitted / np.linalg.eigvalsh(gram / total).max())
    for metric in (inverse, plain):
        rated, miss, step, idle, depth = first, miss_of(first), 1.0, 0, 0
        for _ in range(most_iterations):
            if np.abs(miss).max() <= tolerance or idle >= MOST_IDLE or step < 1e-3:
                break
            slope = step * (metric @ miss)
            moved = F.col("rate") - sum((c * F.lit(float(s)) for c, s in zip(p, slope, strict=True)), F.lit(0.0))
            moved = F.least(F.greatest(F.lit(float(least)), moved), F.lit(MOST_RATE))
            tried = rated.withColumn("rate", F.when(stays, moved).otherwise(0.0) if least > 0 else moved)
            after = miss_of(tried)
            gain = 1 - (after @ metric @ after) / max(miss @ metric @ miss, 1e-300)
            if gain < 0:
                step /= 2
                continue
            rated, miss, step, idle, depth = tried, after, min(1.0, 2 * step), idle + 1 if gain < 0.002 else 0, depth + 1
            if depth % 8 == 0:
                rated = materialize(rated, "rates", 1_000_000)
        if np.abs(miss).max() <= tolerance:
            break
    return rated.withColumn("rate", F.round("rate", 6))


def document_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> DataFrame:
    """row_key, doc_id, n_tokens, p_<domain>, rate and copies.

    copies is the rate, rounded up as often as its fraction says by a hash of the row, so that the
    expected totals are those of the rates. Rows that agree in id and text are rounded alike.
    """
    docs = keyed(docs, id_col, text_col)
    sample = labelled_sample(docs, labels, sample_rows).persist()  # bounded, and read four times
    model = fit_classifier(sample)
    sample.unpersist()
    members = materialize(posteriors(docs, model), "posteriors")
    unit = F.pmod(F.xxhash64("row_key", F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)  # in [0, 1)
    return fit_rates(members, weights, least=least).withColumn("copies", F.floor(F.col("rate") + unit).cast("int"))


def mix_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as often as its copies say. What is rather toxic goes, everything else stays once at least."""
    rates = document_rates(docs, labels, weights, id_col=id_col, text_col=text_col, least=1.0)
    changed = materialize(rates.where("copies <> 1").select("row_key", "doc_id", "copies").distinct(), "copies", 1_000_000)
    same = (row_key(docs, id_col, text_col) == changed["row_key"]) & docs[id_col].eqNullSafe(changed["doc_id"])
    each = F.array_repeat(F.lit(1), F.coalesce(changed["copies"], F.lit(1)))
    return docs.join(changed, same, "left").select(*(docs[f"`{c}`"] for c in docs.columns), F.explode(each).alias(free_name(docs, "copy"))).drop(free_name(docs, "copy"))
