import datetime as dt
import random

from pyspark.sql import functions as F

from lexiforge.operators import discovery, state
from lexiforge.plans import compose
from lexiforge.sources import corpus
from lexiforge.streaming import state_machines


def test_versions_keep_the_older_baseline(spark):
    rows = [("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("u", 4, "b"), ("u", 5, "a"), ("v", 1, None)]
    out = state.versions(spark.createDataFrame(rows, "url string, at int, content string"), "url", "at", "content")
    assert [r.previous_content for r in out.orderBy("url", "at").collect()] == [None, None, "a", "a", "b", None]


def test_recency(spark):
    def order(entries):
        df = spark.createDataFrame([(1, i, loc, mod) for i, (loc, mod) in enumerate(entries)], "site int, ord int, loc string, lastmod string")
        return [r.ord for r in discovery.rank_by_recency(df, ["site"]).orderBy("position").collect()]

    assert order([("a", "2020-01-01"), ("b", "2024-01-01"), ("c", None)]) == [1, 0, 2]
    assert order([("a", "2020-01-01"), ("b", "2024-01-01"), ("c", None), ("d", None)]) == [0, 1, 2, 3]
    assert order([("a", "2024-02-31"), ("b", "2024-01-01"), ("x/2024/03/y", None)]) == [2, 1, 0]


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    out = discovery.crawl(links, spark.createDataFrame([("a",)], "url string"), 2, lambda df: df)
    assert {(r.url, r.depth) for r in out.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def log_rows():
    at = dt.datetime(2024, 1, 1)
    rows, seq = [], 0
    for engine, marks in (("e1", "++--"), ("e2", "--+"), ("e3", "-"), ("e4", "+---")):
        for m in marks:
            seq += 1
            rows.append((engine, at + dt.timedelta(seconds=seq), seq, m == "+", 100, "connection" if engine == "e4" else "blocked"))
    return rows


LOG = "engine string, at timestamp, seq long, ok boolean, latency long, reason string"


def test_health_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(log_rows(), LOG)
    batch = {r.engine: (r.successes, r.failures, r.consecutive, r.blocked_until) for r in state.engine_health(df).collect()}
    assert [batch[e][2] for e in ("e1", "e2", "e3", "e4")] == [2, 0, 1, 3]
    for k in range(3):
        df.where(F.col("seq") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    # in order of time: one file a batch
    files = spark.createDataFrame(log_rows(), LOG).orderBy("seq")
    files.coalesce(1).write.parquet(str(tmp_path / "ordered"))
    stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "ordered"))
    q = state_machines.engine_health_stream(stream).writeStream.outputMode("update").format("memory").queryName("health").start()
    q.processAllAvailable()
    q.stop()
    assert {r.engine: (r.successes, r.failures, r.consecutive, r.blocked_until) for r in spark.table("health").collect()} == batch


def test_queue_stream_equals_batch(spark, tmp_path):
    ops = [("p1", "u1", 1, "add"), ("p1", "u2", 2, "next"), ("p1", "u1", 3, "fail"), ("p2", "u3", 4, "add"), ("p2", "u3", 5, "complete"), ("p3", "u", 6, "fail"), ("p3", "u", 7, "fail"), ("p3", "u", 8, "fail")]
    schema = "path string, url string, seq long, op string"
    df = spark.createDataFrame(ops, schema)
    batch = {r.path: (r.url, r.retries, r.status) for r in state.queue_state(df).collect()}
    assert batch == {"p1": ("u1", 1, "queued"), "p2": ("u3", 0, "completed"), "p3": ("u", 3, "failed")}
    df.coalesce(1).write.parquet(str(tmp_path / "q"))
    q = state_machines.queue_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "q"))).writeStream.outputMode("update").format("memory").queryName("queue").start()
    q.processAllAvailable()
    q.stop()
    assert {r.path: (r.url, r.retries, r.status) for r in spark.table("queue").collect()} == batch


def test_windows_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, engine string, ok boolean, latency long"
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    for name, minutes in (("1", [1, 2, 130]), ("2", [3]), ("3", [300])):
        spark.createDataFrame([(at(m), "e", True, 1) for m in minutes], schema).coalesce(1).write.parquet(str(tmp_path / "w"), mode="append")
    out = state_machines.outcome_windows(spark.read.parquet(str(tmp_path / "w")))
    assert sum(r.n for r in out.collect()) == 5


def test_token_bucket(spark):
    df = spark.createDataFrame([("h", 0)] * 12 + [("h", 1)] * 7 + [("h", 9)] * 20, "host string, second long")
    assert {(r.second, r.passed) for r in state.token_bucket(df).collect()} == {(0, 10), (1, 5), (9, 10)}


def test_size_cap_and_as_of(spark):
    rows = [(i, dt.datetime(2024, 1, 1 + i // 2), 10) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, bytes int")
    assert sorted(r.id for r in state.evict_by_size(df, "ts", "bytes", 35, "id").collect()) == [4, 6, 7]


def test_sources(spark, tmp_path):
    (tmp_path / "md" / ".hidden").mkdir(parents=True)
    (tmp_path / "md" / "a.md").write_text("---\nurl: https://a\n---\nhello corpus\n\nworld")
    (tmp_path / "md" / ".hidden" / "b.md").write_text("no")
    docs = corpus.read_markdown(spark, str(tmp_path / "md"))
    assert [(r.url, r.text) for r in docs.collect()] == [("https://a", "hello corpus\n\nworld")]
    chunks = spark.createDataFrame([("a", 1, "hello corpus")], "file string, chunk int, text string")
    corpus.write_index(chunks, str(tmp_path / "ix"))
    assert corpus.read_index(spark, str(tmp_path / "ix")).first().n_terms == 2
    try:
        corpus.read_index(spark, str(tmp_path / "none"))
        raise AssertionError
    except corpus.CorpusError as e:
        assert e.reason == "missing"


def test_fetch_source(spark):
    class Fake(corpus.FetchSource):
        transport = staticmethod(lambda url: (200, f"<p>{url}</p>"))

        @classmethod
        def name(cls):
            return "fake_pages"

    spark.dataSource.register(Fake)
    out = spark.read.format("fake_pages").option("urls", "https://a\nhttps://b\nhttps://c").load()
    assert {(r.url, r.status) for r in out.collect()} == {("https://a", 200), ("https://b", 200), ("https://c", 200)}


def package(pages, most_total, most_page):
    """The rule, page by page."""
    total, out = 0, []
    for i, text in pages:
        room = most_total - total
        if room <= 200:
            break
        part = text if len(text) <= most_page else text[:most_page] + "\n\n[...truncated]"
        if len(part) > room:
            part = part[:room] + "\n\n[...truncated]"
        total += len(part)
        out.append((i, part))
    return out


def test_context_package(spark):
    rng = random.Random(4)
    for most_total, most_page in ((400, 500), (3000, 250), (1000, 900), (100, 50), (10**6, 100)):
        pages = [(i, "x" * rng.choice([0, 30, 100, 260, 500])) for i in range(60)]
        df = spark.createDataFrame([(i, t, f"https://e.org/{i}", f"T{i}") for i, t in pages], "id int, text string, url string, title string").repartition(3)
        out = compose.context_package(df, "id", most_total, most_page, block=4)
        assert [(r.id, r.part) for r in out.orderBy("id").collect()] == package(pages, most_total, most_page), (most_total, most_page)
    three = spark.createDataFrame([(1, "a" * 100, "u1", "One"), (2, "b" * 500, "u2", "Two"), (3, "c" * 50, "u3", None)], "id int, text string, url string, title string")
    out = compose.context_package(three, "id", 400)
    assert [(r.id, r.n_chars, r.cut) for r in out.orderBy("id").collect()] == [(1, 100, False), (2, 316, True)]
    text = compose.package_document(out, "id", 3, "pack", "2024-01-01T00:00:00Z").first().text
    assert text.startswith("---\npackage: pack\ncompiled_at: 2024-01-01T00:00:00Z\npages: 3\n---\n\n---\n\n# One\n\n<!-- source: u1 -->\n\na")
    assert text.endswith("[...truncated]\n\n---\n\n## Index\n\n- [One](u1) — 100 chars\n- [Two](u2) — 316 chars\n")


def test_bucket_by_hand(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), s) for s in sorted(rng.randrange(120) for _ in range(500))]
    want, tokens, at = {}, {}, {}
    for host, second in sorted(rows):
        tokens[host] = min(10, tokens.get(host, 10) + 5 * (second - at.get(host, second)))
        at[host] = second
        want.setdefault((host, second), 0)
        if tokens[host]:
            tokens[host] -= 1
            want[host, second] += 1
    got = {(r.host, r.second): r.passed for r in state.token_bucket(spark.createDataFrame(rows, "host string, second long")).collect()}
    assert got == want


def test_site_urls(spark):
    rows = [(k, f"https://e.org/p{k}", f"2024-01-{k % 28 + 1:02d}" if k % 3 else None) for k in range(40)] + [(40, "https://e.org/x.png", None), (41, "https://other.org/", None), (42, "https://e.org/p1", None)]
    entries = spark.createDataFrame(rows, "ord int, loc string, lastmod string")
    out = discovery.site_urls(entries, "https://e.org", most=10).orderBy("position").collect()
    want = sorted([r for r in rows[:40] if r[2]], key=lambda r: (-int(r[2][-2:]), r[0]))
    assert [r.loc for r in out] == [r[1] for r in want[:10]] and [r.position for r in out] == list(range(1, 11))
    seeded = discovery.site_urls(entries, "https://e.org", most=10, seed=want[2][1] + "/#top").orderBy("position").collect()
    assert [r.loc for r in seeded] == [want[2][1] + "/#top", *(r[1] for k, r in enumerate(want[:10]) if k != 2)]


def test_census(spark):
    paths = [("r", p) for p in ("src/", "src/a.py", "README", "Dist/x.js", "a/node_modules/b.js", "img.PNG", "docs/readme", ".git/")] + [("s", "x/")]
    out = {r.repo: (r.files, r.folders) for r in discovery.repository_census(spark.createDataFrame(paths, "repo string, path string")).collect()}
    assert out == {"r": (2, 1), "s": (0, 1)} and len(discovery.EXCLUDED_PATHS) == 63
