import datetime

from pyspark.sql import functions as F

from lexiforge.operators import discovery, screening, sections
from lexiforge.streaming import state_machines


def test_pruned(spark):
    text = "Intro words here.\n# Setup\n" + "install it now. " * 20 + "\n# References\n" + "link " * 30 + "\n# Usage\nrun it"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "only text")], "doc_id long, text string")
    out = {r.doc_id: r for r in sections.pruned(df, 100).collect()}
    assert out[1].text.startswith("Intro words here.\n\n# Setup\ninstall") and "# Usage\nrun it" in out[1].text
    assert out[1].omitted == ["References"] and out[3].text == "only text" and 2 not in out
    asked = {r.doc_id: r for r in sections.pruned(df, 10, ["usage"]).collect()}
    assert "# Usage" in asked[1].text and "Setup" in asked[1].omitted


def test_trim_paywall(spark):
    df = spark.createDataFrame([("Start of it.\n\nSubscribe to continue reading now",), ("free",), (None,)], "t string")
    assert [r[0] for r in df.select(screening.trim_paywall(F.col("t"))).collect()] == ["Start of it.", "free", None]


def test_tree(spark):
    df = spark.createDataFrame([("r", p) for p in ("b.txt", "a/", "a/z.txt", "a/c/", "a/c/d.txt", "README")], "repo string, path string")
    out = [r.line for r in discovery.repository_tree(df).orderBy("position").collect()]
    assert out == ["a/", "  c/", "    d.txt", "  z.txt", "README", "b.txt"]


def test_remembered(spark):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    found = spark.createDataFrame([("old", 1, day(7.5)), ("kept", 2, day(13)), ("none", 2, None)], "domain string, rung int, updated timestamp")
    assert {r.domain for r in state_machines.remembered(found, F.lit(day(16))).collect()} == {"kept", "none"}
