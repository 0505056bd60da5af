import math
import random
import shutil
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiforge.functions.text import STOP_WORDS
from lexiforge.operators import retrieval
from lexiforge.sources import postings
from lexiforge.sources.corpus import CorpusError


def tokens(text):
    return [w for w in (text or "").lower().split() if len(w) >= 2 and w not in STOP_WORDS]


def brute(chunks, queries, k, per_file):
    """The hits of each query, over its corpus alone."""
    by = defaultdict(list)
    for corpus, file, chunk, text in chunks:
        by[corpus or ""].append((file, chunk, Counter(tokens(text))))
    out = []
    for q, corpus, text in queries:
        held = by[corpus or ""]
        n, files = len(held), len({f for f, _, _ in held})
        asked = Counter(tokens(text))
        if not held:
            continue
        average = sum(sum(c.values()) for _, _, c in held) / n
        df = {t: sum(t in c for _, _, c in held) for t in asked}
        telling = {t for t in asked if 1 <= len({f for f, _, c in held if t in c}) <= max(1, files * 2 // 3)}
        scores = []
        for file, chunk, c in held:
            if not telling & set(c):
                continue
            s = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / max(average, 1e-9))) for t, m in asked.items() if c[t])
            scores.append((-round(s, 9), file, chunk))
        seen, rank = Counter(), 0
        for s, file, chunk in sorted(scores):
            seen[file] += 1
            if rank < k and (not per_file or seen[file] <= per_file):
                rank += 1
                out.append((q, rank, corpus or "", file, chunk, round(-s, 6)))
    return sorted(out)


@pytest.fixture(scope="module")
def material(spark, tmp_path_factory):
    rng = random.Random(21)
    vocab = ["common", "often", *(f"word{k}" for k in range(80))]
    weights = [60, 30, *(50 / (k + 1) for k in range(80))]
    text = lambda n: " ".join(rng.choices(vocab, weights, k=n))
    chunks = [(rng.choice(["a.org", "a.org", "b.org", None]), f"f{rng.randrange(30)}", k, text(rng.choice([0, 1, 5, 40]))) for k in range(500)]
    chunks += [("a.org", "same", 1000 + k, "word3 word70 often") for k in range(20)] + [("c.org", "one", 1, None), ("c.org", "one", 2, "word1 lonely")]
    queries = [(k, rng.choice(["a.org", "b.org", None, "c.org", "nowhere"]), text(rng.choice([1, 2, 4, 12])) + rng.choice(["", " word3 word3"])) for k in range(40)]
    queries += [(100, "a.org", "common"), (101, "a.org", "unheard of"), (102, "a.org", None), (103, "c.org", "lonely")]
    folder = str(tmp_path_factory.mktemp("index") / "i")
    index = postings.write_postings(spark.createDataFrame(chunks, "corpus string, file string, chunk int, text string").repartition(3), folder)
    return chunks, queries, folder, index


def hits(spark, index, queries, k=8, per_file=2):
    out = retrieval.search(index, spark.createDataFrame(queries, "query_id int, corpus string, text string"), k, per_file)
    return sorted((r.query_id, r["rank"], r.corpus, r.file, r.chunk, round(r.score, 6)) for r in out.collect())


@pytest.mark.parametrize("k,per_file,literals,broadcast", [(8, 2, 200, 200_000), (3, 0, 0, 200_000), (8, 1, 0, 0)])
def test_search_by_brute_force(spark, material, monkeypatch, k, per_file, literals, broadcast):
    chunks, queries, _, index = material
    monkeypatch.setattr(retrieval, "LITERALS", literals)
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", broadcast)
    assert hits(spark, index, queries, k, per_file) == brute(chunks, queries, k, per_file)


@pytest.mark.parametrize("broadcast", [retrieval.MOST_BROADCAST, 0])
def test_a_chunk_is_scored_for_the_query_that_asked_for_it(spark, tmp_path, monkeypatch, broadcast):
    """Not for the others, however many share a term with it; equal queries are answered once."""
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", broadcast)
    texts = [(f, 0, f"red{f} word{f % 2} same") for f in range(6)]
    index = postings.write_postings(spark.createDataFrame(texts, "file int, chunk int, text string"), f"file://{tmp_path}/own")
    queries = spark.createDataFrame([(1, "red1 word1"), (2, "red3 word1"), (3, "red1 word1"), (4, None)], "query_id int, text string")
    asked = retrieval.asked_lists(index, queries.withColumn("corpus", F.lit("")))
    pairs = spark.createDataFrame([(1, "", 5, 0), (1, "", 5, 0), (2, "", 3, 0)], "query_id int, corpus string, file int, chunk int")
    assert sorted((r.query_id, r.file) for r in retrieval._scored(index, pairs, asked).collect()) == [(1, 5), (2, 3)]
    seen, lists = [], retrieval.asked_lists
    monkeypatch.setattr(retrieval, "asked_lists", lambda index, queries, *rest: seen.append(queries.where("text is not null").count()) or lists(index, queries, *rest))
    out = {(r.query_id, r["rank"]): r.file for r in retrieval.search(index, queries, 3).collect()}
    assert seen == [2] and {k: f for k, f in out.items() if k[1] == 1} == {(1, 1): 1, (2, 1): 3, (3, 1): 1} and len(out) == 9


def test_only_asked_folders_are_read(spark, material, tmp_path):
    """Without the folders of all other terms a query has the same hits."""
    chunks, _, folder, _ = material
    asked = [(1, "a.org", "word3 word70"), (2, "b.org", "word5")]
    copy = str(tmp_path / "copy")
    shutil.copytree(folder, copy)
    need = {r[0] for r in spark.createDataFrame([("a.org", "word3"), ("a.org", "word70"), ("b.org", "word5")], "c string, t string").select(postings.bucket(F.col("c"), F.col("t"))).collect()}
    for table in ("postings", "heads"):
        for k in set(range(postings.BUCKETS)) - need:
            shutil.rmtree(f"{copy}/{table}/bucket={k}", ignore_errors=True)
    assert hits(spark, postings.read_postings(spark, copy), asked) == brute(chunks, asked, 8, 2)


def test_scan_is_told_lists_and_impacts(spark, material):
    _, _, _, index = material
    lists = spark.createDataFrame([(0, "a.org", "word3", 1.5)], "bucket int, corpus string, term string, need double")
    length = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = retrieval._of_lists(index.postings, lists, F.col("need"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", length)
    pushed = plan[plan.index("PushedFilters") :]
    assert "EqualTo(term,word3)" in pushed and "GreaterThanOrEqual(impact,1.5)" in pushed
    assert "bucket" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]


def test_index_errors(spark, material, tmp_path):
    _, _, folder, _ = material
    with pytest.raises(CorpusError) as e:
        postings.read_postings(spark, str(tmp_path / "none"))
    assert e.value.reason == "missing"
    copy = str(tmp_path / "old")
    shutil.copytree(folder, copy)
    shutil.rmtree(f"{copy}/_index")
    spark.read.parquet(f"{folder}/_index").withColumn("version", F.lit(1)).write.parquet(f"{copy}/_index")
    with pytest.raises(CorpusError) as e:
        postings.read_postings(spark, copy)
    assert e.value.reason == "version_mismatch"
    shutil.rmtree(f"{copy}/_index")
    spark.range(1).write.parquet(f"{copy}/_index")
    with pytest.raises(CorpusError) as e:
        postings.read_postings(spark, copy)
    assert e.value.reason == "corrupt"


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "file string, chunk int, text string")
    index = postings.write_postings(none, str(tmp_path / "empty"))
    assert hits(spark, index, [(1, None, "word1")]) == []


def test_known_locally(spark, material):
    chunks, _, _, index = material
    targets = [(1, "https://c.org/docs/lonely-page.html", None), (2, "https://a.org/x", " word70 "), (3, "https://unknown.org/word3", None), (4, "no url", "word3"), (5, "https://c.org/", "  ")]
    out = retrieval.known_locally(index, spark.createDataFrame(targets, "target_id int, url string, query string")).collect()
    assert {(r.target_id, r.asked_by) for r in out} == {(1, "url"), (2, "query")}
    want = brute(chunks, [(2, "a.org", "word70")], 3, 2)
    assert sorted((r["rank"], r.file, r.chunk) for r in out if r.target_id == 2) == [(x[1], x[3], x[4]) for x in want]


def test_term_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>").select(postings.term_counts(F.col("t")).alias("c"))
    assert [[tuple(x) for x in r.c] for r in df.collect()] == [[("a", 1), ("b", 2)], []]


def moved_rows(spark):
    """Rows that all stages so far have handed to a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_a_posting_is_moved_once(spark, tmp_path):
    """Neither the counts by file nor the frequencies move the postings, however the frequencies are joined."""
    chunks = [(f, k, " ".join(f"word{(f + 7 * k + j) % 50}" for j in range(25))) for f in range(400) for k in range(2)]
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = moved_rows(spark)
    index = postings.write_postings(spark.createDataFrame(chunks, "file int, chunk int, text string").repartition(2), str(tmp_path / "i"))
    moved = moved_rows(spark) - before
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert index.postings.count() == 20_000
    assert index.lists.agg(F.sum("chunk_df")).first()[0] == 20_000
    assert {r.file_df for r in index.lists.collect()} == {len({f for f, k, _ in chunks if (0 - f - 7 * k) % 50 < 25})}
    assert moved < 30_000
