import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import markdown, screening, state
from lexiforge.plans import cases


def test_fences():
    lines = ["a", "````js", "```", "```` x", "~~~~", "  ````  ", "b", "~~~", "```", "c"]
    assert markdown.fenced(lines) == [False, True, True, True, True, True, False, True, True, True]
    assert markdown.tidy("a  b \r\n\n<Note>\n\t- x\t y\n```\n a  b\n\n```\nsee <Note> here") == "a b\n  - x y\n```\n a  b\n\n```\nsee <Note> here"


def test_line_differences_are_shortest():
    rng = random.Random(1)

    def common(a, b):
        best = 0
        for k in range(len(a), 0, -1):
            if any(all(x in it for x in c) for c in itertools.combinations(a, k) for it in [iter(b)]):
                best = k
                break
        return best

    for _ in range(60):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 7))] for _ in range(2))
        added, removed, unchanged = markdown.difference(a, b)
        assert unchanged == common(a, b) and len(added) == len(b) - unchanged and len(removed) == len(a) - unchanged


def test_parts_of_documents(spark):
    text = "x\n---\n---\ny\n# A\n---\nz\n***\n___\n# B\n# C\n "
    docs = spark.createDataFrame([(1, text), (2, None), (3, "My Title\n\nThis is prose.\n```\nNot A Title\n```\nlower case\nMore prose here.")], "doc_id long, text string")
    parts = [(r.heading, r.body) for r in markdown.prune_sections(docs).where("doc_id = 1").orderBy("section").collect()]
    assert parts == [("", "x"), ("", "---\ny"), ("A", "---\nz"), ("", "___"), ("C", "")]
    assert [(r.doc_id, r.heading) for r in markdown.fallback_headings(docs).collect()] == [(3, "My Title")]
    assert markdown.outline_sections(docs).where("doc_id = 2").count() == 0


def test_adding_again_changes_nothing(spark):
    ops = [("p", "u", 1, "add"), ("p", "u", 2, "next"), ("p", "u", 3, "complete"), ("p", "v", 4, "add"), ("q", "w", 5, "add"), ("q", "w", 6, "add")]
    out = {r.path: (r.status, r.duplicates) for r in state.queue_state(spark.createDataFrame(ops, "path string, url string, seq long, op string")).collect()}
    assert out == {"p": ("completed", 1), "q": ("queued", 1)}


def test_patient_engine(spark):
    log = [(e, f"2024-01-01 00:00:0{k}", k, False, 1, "blocked") for e in ("google", "bing") for k in range(6)]
    rows = spark.createDataFrame(log, "engine string, at string, seq long, ok boolean, latency long, reason string").withColumn("at", F.to_timestamp("at"))
    until = {r.engine: str(r.blocked_until) for r in state.engine_health(rows).collect()}
    assert until == {"google": "2024-01-01 00:01:05", "bing": "2024-01-01 00:10:05"}
    assert all(r.blocked_until is None for r in state.engine_health(rows.where("seq < 5 and engine = 'google'")).collect())


@pytest.mark.parametrize(("text", "kinds"), [("key AKIA" + "ABCDEFGHIJKLMNOP", 1), ("nothing here", 0)])
def test_secret_kinds(spark, text, kinds):
    assert len(spark.range(1).select(screening.secret_types(F.lit(text)).alias("s")).first().s) == kinds


def test_every_planted_answer_is_there():
    assert set(cases.oracle_sql()) >= {"redaction_cases", "paywall_cases", "reader_choices", "private_ips"}


def test_links_to_a_page_that_is_there_twice(spark):
    """Of equal addresses the first by the given column is linked, whatever its path and the order of the rows."""
    rows = [(10, "https://a.org/x", "d1/10.md", ""), (9, "https://a.org/x", "d2/9.md", ""), (11, "https://a.org/x", "d0/11.md", ""), (1, "https://a.org/y", "d1/1.md", "[l](https://a.org/x)")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "page_id int, url string, path string, markdown string")
        assert {r.page_id: r.markdown for r in markdown.rewrite_links(df, "page_id").collect()}[1] == "[l](../d2/9.md)"
