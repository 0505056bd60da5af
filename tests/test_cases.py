"""The cases of ``plans.cases`` alone, with their answers."""

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import urls
from lexiforge.operators import decisions, envelopes, markdown, previews, screening, sections, verticals
from lexiforge.plans import cases

ONE_TO_ONE = {
    "redacted": (cases._REDACTED, screening.redact),
    "curtains": (cases._CURTAINS, screening.trim_curtain),
    "injections": (cases._ACTED, screening.injection_action),
    "styles": (cases._STYLED, markdown.without_styles),
    "fields": (cases._FIELDS, envelopes.scrub_text),
    "records": (cases._RECORDS, envelopes.scrub_record),
    "fronts": (cases._FRONTS, previews.short_front_matter),
    "bodies": (cases._BODIES, previews.json_preview),
}


@pytest.mark.parametrize("name", ONE_TO_ONE)
def test_texts(spark, name):
    answers, f = ONE_TO_ONE[name]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(answers)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(f(F.col("t"))).collect()] == list(answers.values())


def rows(spark, table, n, columns):
    return spark.createDataFrame([(k, *x[:n]) for k, x in enumerate(table)], "k int, " + ", ".join(f"{c} string" for c in columns)).orderBy("k")


def test_choices(spark):
    got = rows(spark, cases._READER, 3, "abc").select(decisions.prefers_reader(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in got] == [x[3] for x in cases._READER]
    got = rows(spark, cases._BODY, 2, "ab").select(decisions.article_body(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [x[2] for x in cases._BODY]
    got = rows(spark, cases._ERRORS, 2, "ab").select(decisions.names_other_url(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [x[2] for x in cases._ERRORS]
    got = rows(spark, cases._CONTEXT, 3, "abc").select(decisions.context_is_related(["evaluation", "retrieval"], F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in got] == [x[3] for x in cases._CONTEXT]
    got = rows(spark, cases._IPS, 1, "a").select(urls.is_private_ip(F.col("a"))).collect()
    assert [r[0] for r in got] == [x[1] for x in cases._IPS]


def test_kinds(spark):
    got = rows(spark, cases._TYPES, 2, "ab").select(decisions.content_kind(F.col("a"), F.col("b")).alias("k")).select("k.*").collect()
    assert [(r.type, r.json, r.html, r.textual) for r in got] == [x[2:] for x in cases._TYPES]
    got = rows(spark, cases._FAILURES, 2, "ab").select(decisions.failure(F.col("a"), F.col("b")).alias("k")).select("k.*").collect()
    assert [(r.category, r.retryable, r.transport) for r in got] == [x[2:] for x in cases._FAILURES]
    got = rows(spark, cases._BODY_WORDS, 2, "ab").select(sections.says_little(F.col("a")), sections.mostly_not_prose(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [x[2:] for x in cases._BODY_WORDS]


def test_routes(spark):
    got = decisions.routed(rows(spark, cases._ROUTED, 1, ["url"]), cases._ROUTES).orderBy("k").collect()
    assert [(r.route, r["mode"]) for r in got] == [x[1:] for x in cases._ROUTED]
    got = decisions.parsed_routes(rows(spark, cases._LINES, 1, ["line"]).withColumnRenamed("k", "ordinal")).collect()
    assert {(r.ordinal, r.pattern, r["mode"]) for r in got} == {(k, *x[1:]) for k, x in enumerate(cases._LINES) if x[1]}


def test_sites_and_lanes(spark):
    got = verticals.render_answers(rows(spark, cases._ANSWERS, 2, ["url", "body"])).orderBy("k").collect()
    assert [(r.vertical, r.markdown) for r in got] == [x[2:] for x in cases._ANSWERS]
    lanes = spark.createDataFrame([(k, *x[:3]) for k, x in enumerate(cases._LANES)], "k int, state string, n int, settled boolean").orderBy("k")
    assert [r[0] for r in lanes.select(decisions.provider_status(F.col("state"), F.col("n"), F.col("settled"))).collect()] == [x[3] for x in cases._LANES]
    outcomes = [(1, "google", 5, None, False, None, 90), (1, "bing", 0, 503, False, None, 1250), (1, "ddg", 0, None, False, "timeout", 1250), (2, "yahoo", 0, 429, True, None, 5)]
    got = decisions.engine_status(spark.createDataFrame(outcomes, "query int, engine string, count int, http_status int, quota boolean, skip_reason string, latency_ms int")).orderBy("query", "engine").collect()
    assert [(r.query, r.engine, r.status, r.note) for r in got if r.status != "disabled"] == [(1, "bing", "http_503", "HTTP 503"), (1, "ddg", "timeout", "timed out after 1.3s"), (1, "google", "ok", None), (2, "yahoo", "quota", "rate-limited / quota exhausted")]
    assert len(got) == 8
