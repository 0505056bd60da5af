import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import text, urls
from lexiforge.operators import store


def by_rule(entries, now, most):
    """The two passes over a list."""
    out, left = {}, []
    for path, at, size, files in entries:
        age = now - at
        if age < 300:
            out[path] = "active"
        elif age > 7 * 86_400:
            out[path] = "expired"
        else:
            left.append((at, path, max(size, most + 1) if files > 20_000 else size))
    total = sum(x[2] for x in left)
    for _, path, size in sorted(left):
        out[path] = "capped" if total > most else "kept"
        total -= size if total > most else 0
    return out


def test_sweep(spark):
    rng = random.Random(5)
    now = 2_000_000
    for most in (0, 500, 3000, 10**6):
        entries = [(f"p{k}", now - rng.randrange(9 * 86_400), rng.randrange(200), rng.choice([1, 5, 5, 30_000]) if most == 3000 else 1) for k in range(120)] + [("same1", now - 5000, 10, 1), ("same2", now - 5000, 10, 1), ("new", now - 10, 10**9, 1)]
        out = store.swept(spark.createDataFrame(entries, "path string, modified long, bytes long, files int"), F.lit(now), most)
        assert {r.path: r.outcome for r in out.collect()} == by_rule(entries, now, most)


def test_lookups(spark):
    versions = spark.createDataFrame([("u", 1, "T", "# A\nold"), ("u", 2, "T", "# A\nnew\n# B\nx"), ("v", 1, None, "same"), ("v", 5, None, "same"), ("w", 1, "W", None)], "url string, at int, title string, content string")
    out = {r.url: r for r in store.content_for(spark.createDataFrame([("u",), ("v",), ("w",), ("x",)], "url string"), versions).collect()}
    assert out["u"].content.startswith("# A\nnew") and out["u"].unchanged is False and out["v"].unchanged is True and out["w"].unchanged is None
    assert out["v"].text.startswith("Retrieved content for v\nLength: 4 chars\nContent hash: ") and "Unchanged since previous version (" in out["v"].text
    assert (out["x"].found, out["x"].text) == (False, "No stored content found for x") and out["w"].length == 0
    changes = store.changes_of(spark.createDataFrame([("u",), ("w",), ("v",)], "url string"), versions).collect()
    assert {(r.url, r.key, r.change) for r in changes} == {("u", "a", "changed"), ("u", "b", "added")}
    results = spark.createDataFrame([(f"r{k}", f"https://e.org/{k}", "fetch", "c" * (60_000 if k == 3 else 5), k, 0 if k % 2 else 100) for k in range(9)], "id string, url string, source string, content string, created_at int, expires_at int")
    got = {r.id: r for r in store.results_for(spark.createDataFrame([("r3",), ("r4",), ("none",)], "id string"), results, F.lit(200)).collect()}
    assert got["r3"].found and got["r3"].text.endswith("c\n\n[... truncated]") and "Length: 60000 chars" in got["r3"].text
    assert not got["r4"].found and got["none"].text == "No result found for ID: none\n\nRecent results:\n" + "\n".join(f"  - r{k}: https://e.org/{k} (fetch)" for k in (7, 5, 3, 1))
    assert "(none)" in store.results_for(spark.createDataFrame([("a",)], "id string"), results.limit(0), F.lit(0)).first().text


def test_keys(spark):
    row = spark.range(1).select(store.summary_key(F.lit("u"), F.lit("  Two\n Words ")).alias("a"), store.summary_key(F.lit("u"), F.lit(None)).alias("b"), store.result_id(F.lit("a"), F.lit("b")).alias("c"), store.result_id(F.lit("ab")).alias("d")).first()
    assert (row.a, row.b, len(row.c)) == ("u\x00two words", "u", 12) and row.c != row.d


ADDRESSES = [
    ("8.8.8.8", 443, "public"), ("8.8.8.8", 22, "dangerous-port"), ("8.8.8.8", None, "public"), ("10.1.2.3", 80, "private-range"), ("10.200.0.1", 5432, "allowed"), ("169.254.169.254", 80, "cloud-metadata"), ("169.254.1.1", 80, "allowed"),
    ("192.0.0.9", 80, "public"), ("256.1.1.1", 80, "private-range"), ("words", 80, "private-range"), ("fd00:ec2::254", 80, "cloud-metadata"), ("::ffff:169.254.169.254", 80, "cloud-metadata"), ("64:ff9b::a9fe:a9fe", 80, "cloud-metadata"),
    ("100::1", 80, "reserved-range"), ("fd12::1", 80, "allowed"), ("fe80::1%eth0", 80, "private-range"), ("::ffff:10.200.0.1", 22, "allowed"), ("2606:4700::1111", 80, "public"), ("[2606:4700::1111]", 6379, "dangerous-port"), ("2002:0a01:0001::", 80, "private-range"), ("64:ff9b:1:a9fe:a9:fe00::", 80, "cloud-metadata"),
]


def test_address_policy(spark):
    allowed = urls.allowed_ranges("10.128.0.0/9, 169.254.0.0/16, fd12::/16, nonsense, 1.2.3.4, 0.0.0.0/0, 100::/64")
    assert allowed == ["10.128.0.0/9", "169.254.0.0/16", "fd12::/16", "100::/64"]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(ADDRESSES)], "k int, ip string, port int, want string")
    got = df.select("k", "want", urls.address_policy(F.col("ip"), F.col("port"), allowed).alias("p")).orderBy("k").collect()
    assert [(ADDRESSES[r.k][0], r.p.decision) for r in got] == [(x[0], x[2]) for x in ADDRESSES]
    assert all(r.p.dangerous == (r.want not in ("public", "allowed")) for r in got)


@pytest.mark.parametrize("value,want", [("Crème Brûlée & ﬁne", "creme-brulee-fine"), ("ŻÓŁĆ źdźbło", "zo-c-zdzb-o"), ("日本", "query"), (None, "query"), ("x" * 60, "x" * 48), ("Ångström № 5", "angstrom-no-5")])
def test_slugs(spark, value, want):
    assert spark.createDataFrame([(value,)], "t string").select(text.slug(F.col("t"))).first()[0] == want


def test_folding(spark):
    got = spark.createDataFrame([("ｉｇｎｏｒｅ ａll",), ("іgnоre​",), ("plain",), (None,)], "t string").select(text.fold_lookalikes(F.col("t"))).collect()
    assert [r[0] for r in got] == ["ignore all", "ignore", "plain", None]


def test_width(spark):
    def width(t):
        return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in t)

    texts = ["plain", "日本語 text", "é" + "é", "ｆｕｌｌ", "한국어", "\x1b[31mred\x1b[0m", "", None, "tab\tand"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.visible_width(F.col("t"))).collect()]
    assert got == [width(t) for t in texts[:5]] + [3, 0, 0, 6]
    cut = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.cut_to_width(F.col("t"), 5)).collect()]
    assert cut == ["plain", "日本…", "éé" if False else "éé", "ｆｕ…", "한국…", "\x1b[31mred\x1b[0m", "", "", "taba…"]
