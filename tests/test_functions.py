import re

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.functions import urls as U
from lexiforge.operators import sections


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_token_estimates(spark):
    rows = {"Hello world.": 2, "\n\n": 1, "international cooperation": 7, "## Head": 3, "https://a.b/c": 4, "日本語テスト": 6, "{}()=>;": 7, "": 0}
    assert values(spark, T.estimate_tokens, rows) == list(rows.values())


def test_terms(spark):
    text = "See ![alt text](u.png) and [link](v) `code` été naïve café-bar"
    assert values(spark, T.terms, [text]) == [["see", "alt", "text", "link", "na", "ve", "caf", "-bar"]]


def test_canonical_urls(spark):
    one = ["https://Example.com:443/a/?utm_source=rss&utm_medium=feed&id=2#section", "https://example.com/a?fbclid=abc123&id=2", "https://example.com/a?id=2"]
    assert len(set(values(spark, U.canonical_url, one))) == 1
    a, b = values(spark, U.canonical_url, ["https://e.com/?b=2&a=1", "https://e.com?a=1&b=2"])
    assert a == b
    assert values(spark, U.canonical_url, ["ftp://example.com/file", "not a url", ""]) == ["ftp://example.com/file", "not a url", ""]
    assert len(set(values(spark, U.canonical_url, ["http://h:8080/", "http://h/", "http://www.h"]))) == 1


@pytest.mark.parametrize(("ip", "private"), [("10.1.2.3", True), ("8.8.8.8", False), ("172.32.0.1", False), ("192.0.0.9", False), ("192.0.0.8", True), ("1.2.3", True), ("256.1.1.1", True), ("100.64.0.1", True)])
def test_private_addresses(spark, ip, private):
    assert values(spark, U.is_private_ipv4, [ip]) == [private]


def test_slug_and_lookalikes(spark):
    assert values(spark, T.slug, ["Été à Paris!", "", "???"]) == ["ete-a-paris", "query", "query"]
    assert values(spark, T.fold_lookalikes, ["іgn​ore"]) == ["ignore"]


def test_redirect_target(spark):
    assert values(spark, U.redirect_target, ["https://duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b%2Fc&rut=1", "https://a.b/c"]) == ["https://a.b/c"] * 2


def test_words_and_terms_are_picked_out(spark):
    """As splitting and replacing have it, for odd texts too."""
    texts = ["", " ", "a", " a\tb\n", "\x0bé-x y_z--", "-- -a-", "A.B `c` d", " nb sp", "[l](u) <b>t</b>"]
    assert values(spark, T.words, texts) == [[w for w in re.split(r"[ \t\n\r\f\x0B]+", t) if w] for t in texts]
    assert values(spark, lambda x: T.terms(x, 1, []), texts[:6]) == [re.findall("[a-z0-9_-]+", t.lower()) for t in texts[:6]]


def test_cost_of_plain_words(spark):
    words = ["a" * 7, "a" * 8, "a.b-c_d?1", "a,b", "語語a", "a" * 9 + "!", "don't", "x" * 9 + "語"]
    assert values(spark, T.estimate_tokens, words) == [sections.cost(w) for w in words]
