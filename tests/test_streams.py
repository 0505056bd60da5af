import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import state
from lexiforge.streaming import memories, ordered

START = dt.datetime(2024, 1, 1)
LOG = "domain string, at timestamp, seq long, rung int, ok boolean"


def stream(spark, tmp_path, batches, schema, build, name):
    """The rows that come out of a stream of these batches, and the state rows after each."""
    folder = str(tmp_path / name)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}-parts/{k}")
        part = next(f for f in os.listdir(f"{folder}-parts/{k}") if f.endswith(".parquet"))
        os.makedirs(folder, exist_ok=True)
        os.rename(f"{folder}-parts/{k}/{part}", f"{folder}/{k:04d}.parquet")
        os.utime(f"{folder}/{k:04d}.parquet", (k + 1_700_000_000, k + 1_700_000_000))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = build(source).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{folder}-checkpoint").start()
    q.processAllAvailable()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    return [r.asDict() for r in spark.table(name).collect()], sizes


def outcomes(rng, n, domains=6, step=400):
    """Outcomes at times that now and then lie more than seven days apart."""
    at, rows = START, []
    for k in range(n):
        at += dt.timedelta(seconds=rng.randrange(step)) + (dt.timedelta(days=8) if rng.random() < 0.02 else dt.timedelta())
        rows.append((f"d{rng.randrange(domains)}", at, k, rng.randrange(3), rng.random() < 0.75))
    return rows


def shuffled(rng, rows, size, end):
    """In batches, each out of order and with some rows of the batch before it again."""
    out, before = [], []
    for k in range(0, len(rows), size):
        batch = rows[k : k + size]
        mixed = batch + rng.sample(before, min(3, len(before)))
        rng.shuffle(mixed)
        out.append(mixed)
        before = batch
    return [*out, [end]]


def by_hand(rows):
    """The states after each event, straight from the rule."""
    known, out = {}, {}
    for domain, at, seq, rung, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        e = known.get(domain)
        if e and at - e["at"] > dt.timedelta(days=7):
            e = None
        if ok and e is None:
            e = {"rung": rung, "n": 1, "probe": False, "bad": {}}
        elif ok and rung < e["rung"]:
            e = {"rung": rung, "n": 1, "probe": False, "bad": {}}
        elif ok:
            e["probe"], e["n"] = False, e["n"] + 1
            e["bad"].pop(rung, None)
            if e["n"] >= 10:
                e["probe"], e["n"] = True, 0
        else:
            e = e or {"rung": 0, "n": 0, "probe": False, "bad": {}}
            e["bad"][rung] = e["bad"].get(rung, 0) + 1
        e["at"] = at
        known[domain] = e
        out[domain, seq] = (e["rung"], e["n"], e["probe"], ",".join(f"{k}:{n}" for k, n in sorted(e["bad"].items())))
    return out, {d: (e["rung"], e["n"], e["probe"], ",".join(f"{k}:{n}" for k, n in sorted(e["bad"].items())), e["at"]) for d, e in known.items()}


def test_strategy_batch_by_hand(spark):
    for seed in range(4):
        rows = outcomes(random.Random(seed), 300, domains=4, step=60_000 if seed % 2 else 400)
        got = {r.domain: (r.rung, r.successes, r.probe, r.failures, r.updated) for r in state.strategy_memory(spark.createDataFrame(rows + rows[:20], LOG)).collect()}
        assert got == by_hand(rows)[1]


def test_strategy_examples(spark):
    def last(*events):
        rows = [("d", START + dt.timedelta(seconds=k), k, rung, ok) for k, (rung, ok) in enumerate(events)]
        r = state.strategy_memory(spark.createDataFrame(rows, LOG)).first()
        return r.rung, r.successes, r.probe, r.failures

    assert last((1, True), (2, True)) == (1, 2, False, "")  # the cheaper one stays
    assert last((2, True), (1, True)) == (1, 1, False, "")
    assert last(*[(1, True)] * 10) == (1, 0, True, "")
    assert last(*[(1, True)] * 11) == (1, 1, False, "")  # tried again, and no longer due
    assert last((2, True), (0, False), (1, False), (0, False), (2, True)) == (2, 2, False, "0:2,1:1")
    assert last((0, False), (2, True)) == (0, 1, False, "0:1")


def test_domains_that_are_remembered(spark):
    rows = [(f"d{k}", START + dt.timedelta(hours=k), k, 1, True) for k in range(400)]
    memory = state.strategy_memory(spark.createDataFrame(rows, LOG))
    now = F.lit(START + dt.timedelta(hours=400))
    assert {r.domain for r in state.remembered_domains(memory, now, 50).collect()} == {f"d{k}" for k in range(350, 400)}
    assert {r.domain for r in state.remembered_domains(memory, now).collect()} == {f"d{k}" for k in range(400 - 7 * 24, 400)}


def test_strategy_stream_is_the_batch(spark, tmp_path):
    """Late, repeated and unordered rows; a watermark of a day; in the end all state is gone."""
    rng = random.Random(7)
    rows = outcomes(rng, 120)
    end = ("~", rows[-1][1] + dt.timedelta(days=30), 10_000, 0, True)
    out, sizes = stream(spark, tmp_path, [*shuffled(rng, rows, 25, end), [("~", end[1] + dt.timedelta(days=3), 10_001, 0, True)]], LOG, lambda s: memories.strategy_memory_stream(s, "1 day"), "strategies")
    seen = {(r["domain"], r["seq"]): (r["rung"], r["successes"], r["probe"], r["failures"]) for r in out if r["seq"] >= 0 and r["domain"] != "~"}
    want = by_hand(rows)[0]
    assert seen == want and len([r for r in out if r["seq"] >= 0 and r["domain"] != "~"]) == len(want)
    assert {r["domain"] for r in out if r["seq"] < 0} >= {r[0] for r in rows}  # each says that it has forgotten
    assert max(sizes) > 20 and sizes[-1] <= 4
    # with probe set, no success follows without clearing it
    for d in {r[0] for r in rows}:
        states = [r for r in sorted(out, key=lambda r: (r["at_ms"], r["seq"])) if r["domain"] == d and r["seq"] >= 0]
        assert all(not r["probe"] for r in states if r["successes"] == 1)
    twin = ordered.replay(spark.createDataFrame(rows, LOG), "domain", "at", "seq", memories.strategy, "rung int, successes int, probe boolean, failures string", 7 * memories.DAY_MS)
    assert {(r.key, r.seq): (r.rung, r.successes, r.probe, r.failures) for r in twin.collect()} == want


def test_strategy_stream_goes_on_from_a_table(spark, tmp_path):
    rows = [("d", START + dt.timedelta(hours=k), k, 2 if k % 4 else 1, k % 3 > 0) for k in range(24)]
    first, rest = rows[:12], rows[12:]
    memory = state.strategy_memory(spark.createDataFrame(first, LOG))
    end = ("~", START + dt.timedelta(days=2), 1000, 0, True)
    out, _ = stream(spark, tmp_path, [rest, [end]], LOG, lambda s: memories.strategy_memory_stream(s, initial=memories.known_strategies(memory)), "going_on")
    want = by_hand(rows)[0]
    assert {(r["domain"], r["seq"]): (r["rung"], r["successes"], r["probe"], r["failures"]) for r in out if r["domain"] == "d"} == {k: v for k, v in want.items() if k[1] >= 12}


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    late = ("d", START, 99, 0, True)
    rows = [[("d", START + dt.timedelta(hours=5), 1, 2, True)], [("~", START + dt.timedelta(hours=9), 2, 0, True)], [late], [("~", START + dt.timedelta(hours=11), 3, 0, True)]]
    out, _ = stream(spark, tmp_path, rows, LOG, memories.strategy_memory_stream, "too_late")
    assert [(r["rung"], r["seq"]) for r in out if r["domain"] == "d"] == [(2, 1)]


OPS = "service string, at timestamp, seq long, op string, seconds long"


def test_latch(spark, tmp_path):
    rng = random.Random(9)
    rows, at = [], START
    for k in range(120):
        at += dt.timedelta(seconds=rng.randrange(200))
        limited = rng.random() < 0.2
        rows.append((f"s{rng.randrange(3)}", at, k, "limited" if limited else "request", rng.choice([None, 5, 300]) if limited else None))
    until, want = {}, {}
    for s, t, k, op, seconds in rows:
        if op == "limited":
            until[s] = t + dt.timedelta(seconds=600 if seconds is None else seconds)
        else:
            want[s, k] = s not in until or t >= until[s]
    assert set(want.values()) == {True, False}
    batch = {(r.service, r.seq): r.passed for r in state.latched(spark.createDataFrame(rows, OPS)).collect()}
    end = ("~", at + dt.timedelta(days=1), 1000, "request", None)
    out, _ = stream(spark, tmp_path, shuffled(rng, rows, 30, end), OPS, lambda s: memories.latch_stream(s, "2 hours"), "latch")
    assert batch == want == {(r["service"], r["seq"]): r["passed"] for r in out if r["service"] != "~"}


CACHE = "name string, at timestamp, seq long, op string, value string"


@pytest.mark.parametrize("ttl", [60, 1800])
def test_cache(spark, tmp_path, ttl):
    rng = random.Random(ttl)
    rows, at = [], START
    for k in range(150):
        at += dt.timedelta(seconds=rng.randrange(60))
        op = rng.choice(["put", "get", "get", "get", "drop"] if k % 9 else ["put"])
        rows.append((f"n{rng.randrange(4)}", at, k, op, f"v{k}" if op == "put" else None))
    held, want = {}, {}
    for n, t, k, op, value in rows:
        if op == "get":
            hit = n in held and t - held[n][0] <= dt.timedelta(seconds=ttl)
            want[n, k] = (hit, held[n][1] if hit else None)
        else:
            held.pop(n, None)
            held |= {n: (t, value)} if op == "put" else {}
    batch = {(r.name, r.seq): (r.hit, r.value) for r in state.cache_answers(spark.createDataFrame(rows, CACHE), ttl).collect()}
    end = ("~", at + dt.timedelta(days=1), 1000, "get", None)
    out, sizes = stream(spark, tmp_path, [*shuffled(rng, rows, 50, end), [("~", end[1] + dt.timedelta(days=1), 1001, "get", None)]], CACHE, lambda s: memories.cache_stream(s, ttl, "2 hours"), f"cache{ttl}")
    assert {hit for hit, _ in want.values()} == {True, False}
    assert batch == want == {(r["name"], r["seq"]): (r["hit"], r["value"]) for r in out if r["name"] != "~"}
    assert sizes[-1] <= 3
