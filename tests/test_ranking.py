import pytest
from pyspark.sql import functions as F

from lexiforge.operators import bm25, ranking, research

CHUNKS = [
    *(("comparison.md", n, f"Benchmark this: the state here is a library state. Benchmark {n} covers benchmark coverage of state options.") for n in range(1, 7)),
    ("middleware.md", 1, "The persist middleware writes your state to localStorage so it survives reloads. Benchmark notes apply too."),
    ("immer.md", 1, "The immer middleware updates nested state immutably. Benchmark notes apply too."),
    ("devtools.md", 1, "The devtools middleware logs every state transition in the Redux devtools panel."),
    ("shallow.md", 1, "useShallow selects a slice of state and prevents rerenders on unrelated updates."),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return bm25.index(spark.createDataFrame(CHUNKS, "file string, chunk int, text string"))


def test_a_term_of_all_files_finds_nothing(corpus):
    assert bm25.corpus_search(corpus, "state").count() == 0
    assert {round(r.score, 6) for r in bm25.scores(corpus, "state").where("file = 'comparison.md'").collect()} == {0.076042}


def test_persist(corpus):
    top = bm25.corpus_search(corpus, "persist localStorage").collect()
    assert [(r.file, round(r.score, 6)) for r in top] == [("middleware.md", 4.020334)]


def test_file_cap(corpus):
    assert [r.file for r in bm25.corpus_search(corpus, "benchmark").orderBy("rank").collect()] == ["comparison.md", "comparison.md", "immer.md", "middleware.md"]


def test_single_score(spark):
    row = spark.createDataFrame([("a kitten story",)], "t string").select(bm25.single_score(F.col("t"), ["kitten"])).first()
    assert round(row[0], 6) == 0.287682


def hits(spark):
    rows = []
    for i in range(4):
        for engine, weight in (("google", 10), ("bing", 3), ("ddg", 2)):
            rows.append(("zzz qqq xxx", engine, i, f"https://spam.example/page-{i}", f"Spam {i}", "", "spam.example", weight))
    rows += [("zzz qqq xxx", "google", 10 + k, f"https://good-{s}.com/", f"Good {s}", "", f"good-{s}.com", 10) for k, s in enumerate("abc")]
    return spark.createDataFrame(rows, "query string, engine string, rank int, url string, title string, snippet string, domain string, weight int")


def test_domain_cap_demotes_and_drops_nothing(spark):
    out = ranking.rank_results(hits(spark)).orderBy("position").collect()
    assert [r.domain.startswith("spam") for r in out] == [True, True, False, False, False, True, True]
    assert {(r.domain.startswith("spam"), r.score) for r in out} == {(True, 23.0), (False, 14.0)}
    free = ranking.rank_results(hits(spark), domain_cap=0).orderBy("position").collect()
    assert [r.domain for r in free[:3]] == ["spam.example"] * 3


def test_redirects(spark):
    title = "pathlib — Object-oriented filesystem paths"
    rows = [
        ("https://www.google.com/goto?url=x", title, "docs.python.org"),
        ("https://docs.python.org/3/pathlib.html", title + " — documentation", "docs.python.org"),
        ("https://www.google.com/goto?url=y", title, "other.org"),
        ("https://www.google.com/url?q=z", "Unrelated", "docs.python.org"),
    ]
    kept = ranking.drop_redirects(spark.createDataFrame(rows, "url string, title string, domain string"))
    assert {r.url for r in kept.collect()} == {r[0] for r in rows[1:]}


def test_profiles_and_preferred(spark):
    df = spark.createDataFrame([("docs.x.org", "Reference", "https://docs.x.org/api/")], "d string, t string, u string")
    m = ranking.profile_matches(ranking.PROFILES["docs-first"], F.col("d"), F.col("t"), F.col("u"))
    assert df.select(ranking.profile_bonus(m)).first()[0] == 13
    assert df.select(ranking.prefers(F.lit("How to use Python"), F.lit("www.docs.python.org"))).first()[0]


def test_stance(spark):
    q = "new battery technology energy density charging speed"
    rows = [
        (q, "The new battery technology has great energy density and charging speed.", False, None),
        (q, "The new battery technology was Debunked; researchers found no evidence for its energy density and charging speed myth.", False, None),
        (q, "Sunny weather with light rain tomorrow.", False, None),
        (q, "The new battery technology has great energy density and charging speed.", True, None),
    ]
    df = spark.createDataFrame(rows, "query string, text string, primary boolean, published timestamp")
    out = research.stance(df, F.to_timestamp(F.lit("2024-01-01"))).collect()
    by = {(r.label, r.primary): r for r in out}
    assert by["neutral", False].strength == 0 and by["conflicting", False].strength < 0
    assert by["conflicting", False].markers == ["debunked", "myth", "no evidence"]
    assert by["supporting", True].strength > by["supporting", False].strength > 0
    assert {r.freshness for r in out} == {0.5}
    assert research.verdicts(research.stance(df, F.to_timestamp(F.lit("2024-01-01")))).first().verdict in ("likely_supported", "contested")
