import numpy as np
from pyspark.sql import functions as F

from lexiforge.llm import mixing
from lexiforge.llm.common import keyed
from tests.llm.test_others import corpus

DATA = "/root/testdata/sf0.1"


def test_toxic_documents_held_out_in_each_language(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = F.xxhash64("doc_id") % 3 == 0
    model = mixing.fit_classifier(mixing.labelled_sample(docs, labels.where(~held)).persist())
    toxic = docs.join(labels.where(held & (F.col("toxic") == 1)).select("doc_id").distinct(), "doc_id")
    said = mixing.posteriors(keyed(toxic), model).join(toxic.select("doc_id", "lang").distinct(), "doc_id")
    found = {r.lang: (r.hits, r.n) for r in said.groupBy("lang").agg(F.count_if(F.col("p_toxic") >= 0.5).alias("hits"), F.count("*").alias("n")).collect()}
    assert set(found) == {"en", "de", "fr", "es"} and all(hits >= 0.7 * n for hits, n in found.values()), found
    # and few others are taken for toxic
    clean = docs.join(labels.where(held & (F.col("toxic") == 0)).select("doc_id").distinct(), "doc_id")
    share = mixing.posteriors(keyed(clean), model).agg(F.avg((F.col("p_toxic") >= 0.5).cast("int"))).first()[0]
    assert share <= 0.01, share


def shares(out, labels):
    """Shares of the tokens of high and low among labelled rows that are not toxic."""
    kind = {i: q for i, q, t in labels if not t}
    total = [0, 0]
    for r in out.select("doc_id", F.size(F.split("text", " ")).alias("n")).collect():
        if r.doc_id in kind:
            total[1 - kind[r.doc_id]] += r.n
    return total[0] / sum(total)


def test_copies_meet_the_targets(spark, documents, tmp_path):
    rows, labels = corpus(800)
    # rates of low documents near 1.4, which the nearest whole number would undo
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = mixing.mix_documents(documents(rows), known, {"high": 0.68, "low": 0.32})
    assert abs(shares(out, labels) - 0.68) < 0.03
    assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, _, t in labels if not t}
    rates = mixing.document_rates(documents(rows), known, {"high": 0.68, "low": 0.32}).agg(*(F.sum(F.col(c) * F.col("n_tokens")) for c in ("rate", "copies"))).first()
    assert abs(rates[1] / rates[0] - 1) < 0.03


def test_pipeline_mixes_to_its_weights(spark, documents, tmp_path):
    import corpus_pipeline

    rows, labels = corpus(800)
    few = [(r, x) for r, x in zip(rows, labels, strict=True) if x[1] or x[0] % 2]  # half of the low ones
    spark.createDataFrame([x for _, x in few], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.mixing(spark, documents([r for r, _ in few]), str(tmp_path))
    assert abs(shares(out, labels) - corpus_pipeline.WEIGHTS["high"]) < 0.04


def fitted(members, weights, least=0.0, rounds=200_000):
    """The same squares by plain numpy: rates of (n_tokens, posteriors) rows, with small steps to the end."""
    n, p = np.array([m[0] for m in members], float), np.array([m[1:] for m in members], float)
    gram = (p * n[:, None]).T @ p
    stays = p[:, 2] < 0.5
    want = (p[stays] * n[stays, None]).sum(axis=0)
    share = np.array([weights["high"], weights["low"]])
    want[:2] = share / share.sum() * want[:2].sum()
    speed = 1 / np.linalg.eigvalsh(gram / n.sum()).max()
    rate = np.ones(len(n))
    for _ in range(rounds):
        miss = (p.T @ (n * rate) - want) / n.sum()
        moved = np.clip(rate - speed * p @ miss, least, mixing.MOST_RATE)
        if np.abs(moved - rate).max() < 1e-9:
            break
        rate = moved
    miss = (p.T @ (n * rate) - want) / n.sum()
    return miss @ miss, want, p, n


def test_rates_against_brute_force(spark):
    """Targets that can be met, and targets that no nonnegative rates meet."""
    rng = np.random.default_rng(6)
    for top in (0.95, 0.25):
        low = rng.uniform(0.02, top, 80)
        toxic = np.where(rng.random(80) < 0.15, 0.9, 0.02)
        members = [(int(n), float((1 - t) * (1 - x)), float((1 - t) * x), float(t)) for n, x, t in zip(rng.integers(1, 300, 80), low, toxic)]
        best, want, p, n = fitted(members, {"high": 0.3, "low": 0.7})
        table = spark.createDataFrame([(k, *m) for k, m in enumerate(members)], "k long, n_tokens long, p_high double, p_low double, p_toxic double")
        rate = np.array([r.rate for r in mixing.fit_rates(table, {"high": 0.3, "low": 0.7}).orderBy("k").collect()])
        miss = (p.T @ (n * rate) - want) / n.sum()
        assert (best < 1e-6) == (top > 0.5) and rate.min() >= 0 and rate.max() <= mixing.MOST_RATE
        assert np.abs(miss).max() <= mixing.TOLERANCE + 1e-6 if best < 1e-6 else miss @ miss <= 1.1 * best, (top, miss, best)


def test_labels_of_one_kind(spark, documents):
    rows, _ = corpus(60)
    for quality, toxic in ((1, 0), (0, 0), (0, 1)):
        known = spark.createDataFrame([(i, quality, toxic) for i, _ in rows], "doc_id long, quality int, toxic int")
        rates = mixing.document_rates(documents(rows), known, {"high": 0.7, "low": 0.3}).collect()
        assert {(r.rate, r.copies) for r in rates} == ({(0.0, 0)} if toxic else {(1.0, 1)})
        assert {r.p_toxic for r in rates} == {float(toxic)}
        assert mixing.mix_documents(documents(rows), known, {"high": 0.7, "low": 0.3}).count() == (0 if toxic else 60)


def test_targets_beyond_reach(spark, documents):
    """One low document cannot be two thirds of the tokens of all: it is repeated as often as allowed."""
    rows, labels = corpus(100)
    few = [(r, x) for r, x in zip(rows, labels) if x[1] and not x[2] or x[0] == 3]
    known = spark.createDataFrame([x for _, x in few] * 1, "doc_id long, quality int, toxic int")
    out = mixing.document_rates(documents([r for r, _ in few]), known, {"high": 0.01, "low": 0.99}, least=1.0).collect()
    assert all(1 <= r.rate <= mixing.MOST_RATE for r in out if r.p_toxic < 0.5)
    assert max(out, key=lambda r: r.rate).doc_id == max(out, key=lambda r: r.p_low).doc_id
