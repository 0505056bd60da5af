import pytest
from pyspark.sql import functions as F

from lexiforge.operators import decisions, ranking, screening, serp, verticals
from lexiforge.plans.compose import answer_each

MARK = "path array<string>, text_density double, link_density double, children map<string,int>, attributes map<string,string>, sibling_index int, sibling_count int"
WANTED = (["html", "body", "div", "p"], 0.5, 0.0, {}, {}, 0, 2)
MOVED = (["html", "body", "p"], 0.5, 0.0, {"b": 1}, {}, 3, 4)


def similarity(spark, a, b):
    rows = spark.createDataFrame([(a, b)], f"a struct<{MARK.replace(' ', ':').replace(',:', ',')}>, b struct<{MARK.replace(' ', ':').replace(',:', ',')}>")
    return rows.select(decisions.element_similarity(F.col("a"), F.col("b"))).first()[0]


def test_similarity_by_hand(spark):
    assert similarity(spark, WANTED, WANTED) == pytest.approx(1.0)
    # a quarter of the path, depth 3 of 4, an empty child list, 2 siblings against 4
    assert similarity(spark, WANTED, MOVED) == pytest.approx(0.3 / 4 + 0.1 * 0.55 / 0.8 + 0.15 + 0.05 + 0.1 + 0.1 + 0.025)
    with_ids = (*WANTED[:3], {"b": 1, "i": 2}, {"id": "x", "class": "c"}, 1, 2)
    other_ids = (*WANTED[:3], {"b": 1, "i": 3}, {"id": "y", "class": "c"}, 0, 2)
    assert similarity(spark, with_ids, other_ids) == pytest.approx(0.3 + 0.1 + 0.15 + 0.05 + 0.2 / 2 + 0.1 * 1.3 / 2 + 0.05)


def test_elements_are_found_again(spark):
    mark = f"struct<{MARK.replace(' ', ':').replace(',:', ',')}>"
    unlike = (["a", "b", "c", "d", "e", "f", "g", "p"], 0.01, 0.9, {"x": 1}, {"id": "q"}, 7, 90)
    wanted = spark.createDataFrame([(k, WANTED) for k in range(5)], f"page int, mark {mark}")
    rows = [(0, 0, MOVED), (0, 1, WANTED), (1, 0, MOVED), (2, 0, unlike), (3, 5, WANTED), (3, 4, WANTED), (4, 0, ([], 0.0, 0.0, {}, {}, 0, 1))]
    found = decisions.located(wanted, spark.createDataFrame(rows, f"page int, place int, mark {mark}"))
    assert {r.page: r.place for r in found.collect()} == {0: 1, 1: 0, 3: 4}


def test_404_that_a_browser_resolves(spark):
    rows = spark.createDataFrame([(404, 200, True), (404, 404, True), (404, 200, False), (403, 200, True), (None, 200, True)], "a int, b int, h boolean")
    assert [r[0] for r in rows.select(decisions.resolves_404(F.col("a"), F.col("b"), F.col("h"))).collect()] == [True, False, False, False, False]


def test_two_stages_count_the_web_as_one_engine(spark):
    shape = "query string, engine string, rank int, url string, title string, snippet string, domain string, weight int"
    hit = lambda engine, url, weight: ("q", engine, 1, url, "A title", "words", "a.org", weight)
    web = spark.createDataFrame([hit("google", "https://a.org/x", 3), hit("bing", "https://a.org/x?utm_source=y", 2)], shape)
    others = spark.createDataFrame([hit("reddit", "https://a.org/x", 1)], shape)
    one, two = (df.collect() for df in (ranking.rank_results(web.union(others)), ranking.rank_in_two_stages(web, others)))
    assert [r.url for r in one] == [r.url for r in two] and len(two) == 1
    assert one[0].score - two[0].score == pytest.approx((3 + 2) - (1 + 1))  # each of the two addresses counts 1 in the second stage
    assert ranking.rank_in_two_stages(web.limit(0), others.limit(0)).collect() == []


def test_each_page_answers_by_its_own_chunks(spark):
    filler = " ".join(["word"] * 60)
    page = f"# Facts\n\nRetrieval is measured by evaluation. {filler}\n\n{filler}\n\nomega {filler}"
    docs = spark.createDataFrame([(1, page), (2, "nothing of it"), (3, ""), (4, None)], "doc_id int, text string")
    out = {r.doc_id: r for r in answer_each(docs, "evaluation of retrieval", k=1, most_tokens=90, overlap=5).collect()}
    assert set(out) == {1, 2}
    assert out[1].answer.startswith("> **Facts**\n\n") and "measured by evaluation" in out[1].answer and out[1].omitted >= 1
    assert (out[2].answer, out[2].omitted) == ("nothing of it", 0)
    last = answer_each(docs.where("doc_id = 1"), "omega", k=1, most_tokens=90, overlap=5).first()
    assert last.answer.startswith("> **Facts**\n\n") and "omega" in last.answer and "evaluation" not in last.answer  # the heading is an earlier chunk's


def test_result_pages_of_odd_markup(spark):
    rows = [("q", "bing", None), ("q", "bing", ""), ("q", None, "<li>"), ("q", "bing", "<li class='b_algo'><h2><a href='https://x.org/%zz'>T"), ("r", "bing", "<li class=b_algo><h2><a href='/ck/a?u=a1%%%'>T</a></h2></li>")]
    out = serp.page_hits(spark.createDataFrame(rows, "query string, engine string, html string")).collect()
    assert [(r.query, r.rank, r.url, r.domain) for r in out] == [("q", 1, "https://x.org/%zz", "x.org")]


def test_texts_without_anything_to_trim(spark):
    rows = spark.createDataFrame([(None,), ("",), ("x" * 100_000,)], "t string")
    assert [r[0] for r in rows.select(screening.trim_curtain(F.col("t"))).collect()] == [None, "", "x" * 100_000]
    assert [r[0] for r in rows.select(screening.injection_action(F.col("t"))).collect()] == [None, "", "x" * 100_000]


def test_hotspots_by_category(spark):
    body = '{"hotspots":[{"securityCategory":"xss","vulnerabilityProbability":"HIGH"},{"securityCategory":"xss","vulnerabilityProbability":"low"},{"vulnerabilityProbability":"MEDIUM"}]}'
    out = verticals.hotspot_groups(spark.createDataFrame([("u", body), ("v", "no json"), ("w", None)], "url string, body string")).collect()
    assert {tuple(r) for r in out} == {("u", "xss", 2, 1, 0, 1), ("u", "other", 1, 0, 1, 0)}
