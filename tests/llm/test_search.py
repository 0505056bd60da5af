import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import divergence, language, lexical, queries

DATA = "/root/testdata/sf0.001"
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sql(name, **tables):
    """Rows of the query's SQL; ``tables``: name and rows of those that are not the given ones."""
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    return sorted((dict(zip(names, r, strict=True)) for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_lexical_search"])
def test_against_sql(spark, name):
    out = queries.queries()[name](spark, DATA)
    assert {x for x, _ in out.dtypes} == set(sql(name)[0])
    assert sorted((str([r[c] for c in sorted(out.columns)]) for r in out.collect())) == sorted(str([r[c] for c in sorted(r)]) for r in sql(name))


def brute_divergence(rows, least, most):
    counts, total, has, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = LETTERS.findall(lower(text))
        counts[lang, source].update(found)
        total[lang].update(found)
        has[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in has[lang].items() if n >= least]
        p = lambda c: {t: 1 + 1000000000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        own, whole = p(counts[lang, source]), p(total[lang])
        pairs = []
        for x, other in groups:
            if x == lang and other != source:
                q = p(counts[lang, other])
                pairs.append((-sum(abs(own[t] - q[t]) for t in kept), other.encode()))
        terms = [(whole[t] - own[t], t.encode()) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, found, end in (("pair", pairs, None), ("term", terms, most)):
            out += [(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(found)[:end], 1)]
    return sorted(out)


def test_divergence_by_brute_force(spark):
    rng = random.Random(11)
    vocab = ["A", "b", "é", "É", "日本", "x" * 300, "zz", "Zz", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for k in range(300):
        lang = rng.choice(["x", "x", "x", "y", None, ""])
        source = rng.choice(["hot", "hot", "a", "B", "ß", None, ""]) if lang != "y" else rng.choice(["p", "q"])
        mine = vocab[: 6 + len(source or "") * 7]
        rows.append((lang, source, rng.choice([" ", "1", "\n"]).join(rng.choices(mine, k=rng.randint(0, 30)))))
    rows += [("x", "hot", None), ("x", "hot", ""), ("x", "silent", "12 34"), ("alone", "s", "w w"), ("rare", "s", "w"), ("rare", "t", "v")] + [rows[0]] * 40
    # extra columns with the names used inside
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "lang string, source string, text string, value int, term string").repartition(3)
    for least, most in ((30, 50), (3, 4)):
        out = divergence.source_divergence(df, least, most)
        assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, out.collect())) == brute_divergence(rows, least, most)
    assert divergence.source_divergence(df.limit(0)).count() == 0
    # counts beyond 64 bits once multiplied
    kept = spark.createDataFrame([("x", 5 * 10**10)], "lang string, count long").withColumn("n", F.lit(7 * 10**10)).withColumn("v", F.lit(3))
    assert kept.select(F.expr(divergence._p("count", "n"))).first()[0] == 1 + 10**9 * (5 * 10**10 + 5) // (7 * 10**10 + 15)


def brute_search(docs, items, k):
    terms = [(i, ALNUM.findall(lower(t))) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(ALNUM.findall(lower(t)))
    for item, want in asked.items():
        scores = []
        for i, t in terms:
            tf = Counter(t)
            score = 0
            for x in want & set(tf):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                score += w * (1000000000 * tf[x] // (1000 * tf[x] + 8 * (10 + 90 * len(t) * n_docs // total)))
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("most_broadcast", [lexical.MOST_BROADCAST, 0])
def test_search_by_brute_force(spark, most_broadcast):
    """Ties at the last place, frequent and rare terms, both ways to join."""
    rng = random.Random(12)
    vocab = ["the", "of", *(f"w{k}" for k in range(60))]
    weights = [40, 30, *(60 / (k + 1) for k in range(60))]
    text = lambda n: rng.choice([" ", "-", "é "]).join(rng.choices(vocab, weights, k=n))
    docs = [(k, text(rng.choice([0, 1, 3, 40, 200]))) for k in range(250)]
    docs += [(k + 500, docs[7][1]) for k in range(40)] + [docs[8]] * 30 + [(None, docs[9][1]), (None, None), (700, None), (701, ""), (702, "THE W5 Ünïcode")]
    items = [(k, text(rng.choice([1, 2, 8, 30]))) for k in range(25)] + [(3, "w1 w2"), (None, "w3 the"), (40, None), (41, "nowhere"), (42, docs[7][1]), (43, "ünïcode Ünïcode")]
    # extra columns with the names used inside
    table = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, doc string").repartition(4)
    asked = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, term int")
    for k in (1, 10):
        out = lexical.search(table, asked, k, most_broadcast)
        assert out.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, out.collect()), key=str) == brute_search(docs, items, k)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.limit(0)).count() == 0


def test_heads_of_runs():
    import pyarrow as pa

    batches = [pa.record_batch({"term": pa.array(t, pa.int64()), "s": pa.array(range(len(t)))}) for t in ([1, 1, 1], [], [1, 2, 2, 2], [2, 2], [3])]
    assert [x for b in lexical._heads(2)(iter(batches)) for x in b.column("term").to_pylist()] == [1, 1, 2, 2, 3]


def test_phases_skip_lists(spark):
    """A frequent word's list is read in its head only where the threshold lies above it."""
    docs = [(k, "the " * 3 + f"filler{k}") for k in range(400)] + [(900 + k, "the rare words of one passage " * 3) for k in range(12)]
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "the rare words of one passage")], "item_id long, text string")
    seen = []
    whole = lexical.Postings.sums
    lexical.Postings.sums = lambda self, postings, *a: (seen.append(postings.count()), whole(self, postings, *a))[1]
    try:
        got = lexical.search(table, asked).collect()
    finally:
        lexical.Postings.sums = whole
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == list(range(900, 910))
    assert seen[1] <= 5 * 12 and seen[2] <= 6 * 12


def test_language_families_and_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("x"))
    out = language.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert {r.held_out for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0} == {True}
    held = [r for r in out if r.held_out]
    assert len(out) == docs.count() and 100 < len(held) < 300
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_by_hand(spark):
    """Five labels, two of one family each and one that no family knows; held-out labels that would mislead are not read."""
    rng = random.Random(5)
    letters = {"en": "theandwi", "de": "derundsch", "fr": "lesétàou", "es": "ñelosaió", "q1": "жщыюя"}
    text = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=4)) for _ in range(n))
    rows, wrong = [], []
    for k in range(400):
        lang = list(letters)[k % 5]
        held = zlib.crc32(str(k).encode()) % 5 == 0
        rows.append((k, text(lang, 20), "es" if held else lang))
        wrong.append(lang)
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 345 !!", "en"), (None, text("fr", 20), None), (1003, text("de", 200_000), None), (1004, rows[1][1], None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, gram int")
    out = {r.doc_id: r for r in language.identify(df, rows_per_lang=40, family_rows=20).collect()}
    assert len(out) == len(rows)
    assert np.mean([out[k].lang_pred == lang for k, lang in enumerate(wrong)]) >= 0.99
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (1000, 1001, 1002))
    assert out[None].lang_pred == "fr" and out[None].held_out and out[1003].lang_pred == "de"
    assert (out[1004].lang_pred, out[1004].score) == (out[1].lang_pred, out[1].score)
    # the same on another layout of the table, whatever the order of its rows
    again = {r.doc_id: r for r in language.identify(df.repartition(7), rows_per_lang=40, family_rows=20).collect()}
    assert {k: r.lang_pred for k, r in again.items()} == {k: r.lang_pred for k, r in out.items()}
    assert all(abs(again[k].score - out[k].score) < 1e-5 for k in out)


def test_language_of_few_labels(spark):
    df = spark.createDataFrame([(1, "some words", "en"), (2, "others", "en"), (3, "x", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify(df).collect()} == {("en", 1.0)}
    assert {(r.lang_pred, r.score) for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert language.identify(df.limit(0)).count() == 0


def test_machine_separates():
    rng = np.random.default_rng(1)
    y = np.array([1, -1] * 40)
    rows = [np.unique(rng.integers(0, 50, 10) + (25 if side > 0 else 0)) for side in y]
    w, bias = language.fit_machine(rows, [np.full(len(r), 1 / len(r), np.float32) for r in rows], y)
    margin = np.array([w[r].mean() + bias for r in rows])
    assert (np.sign(margin) == y).all()
