"""Batch forms of the state that a crawler keeps: versions, caches, health of engines, queues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Failures in a row that block, and how long (seconds) by reason.
BLOCK_AFTER, COOLDOWN, COOLDOWN_CONNECTION = 2, 600, 120
#: The same for the engine that is worth waiting for.
PATIENT_ENGINE, PATIENT_BLOCK_AFTER, PATIENT_COOLDOWN = "google", 6, 60


def versions(stores: DataFrame, key: str, at: str, content: str) -> DataFrame:
    """``stores`` with content_hash and, of the version before that had other content, previous_hash and previous_content.

    Storing the same content again keeps the older baseline.
    """
    order = Window.partitionBy(key).orderBy(at)
    hashed = stores.withColumn("content_hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    changed = F.coalesce(F.lag("content_hash").over(order) != F.col("content_hash"), F.lit(True))
    runs = hashed.withColumn("_new", changed).withColumn("_run", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # At the start of a run the row before holds the content before; the rest of the run inherits it.
    before = runs.withColumns({"_ph": F.when(F.col("_new"), F.lag("content_hash").over(order)), "_pc": F.when(F.col("_new"), F.lag(content).over(order))})
    within = Window.partitionBy(key, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return before.withColumns({"previous_hash": F.first("_ph").over(within), "previous_content": F.first("_pc").over(within)}).drop("_new", "_run", "_ph", "_pc")


def latest(rows: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The last row of each key; an aggregate with map-side maxima, so a hot key is no bottleneck."""
    order = F.struct(at, *ties)
    pick = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_r"))
    return pick.select("_r.*")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before its time: union, then last known value."""
    a = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(F.col(key), F.col(at), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    both = a.unionByName(b, allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(upto)).where("_side = 1").drop("_side", "_value")


def evict_oldest(rows: DataFrame, touched: str, most: int, *ties: str) -> DataFrame:
    """The ``most`` rows touched last."""
    return rows.orderBy(F.desc(touched), *ties).limit(most)


def unexpired(rows: DataFrame, expires_at: str, now: Column) -> DataFrame:
    """Rows that still count; 0 never expires."""
    return rows.where((F.col(expires_at) == 0) | (F.col(expires_at) > now))


def evict_by_size(rows: DataFrame, touched: str, size: str, most_bytes: int, *ties: str, bucket: Column | None = None) -> DataFrame:
    """Without the oldest rows whose bytes, from them to the newest, exceed the cap.

    Sums by day first: only the day in which the cap falls is looked at row by row.
    """
    day = (F.col(touched).cast("date") if bucket is None else bucket).alias("_day")
    dated = rows.withColumn("_day", day)
    days = dated.groupBy("_day").agg(F.sum(size).alias("_bytes"))
    newer = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each day
    days = days.withColumn("_newer", F.coalesce(F.sum("_bytes").over(newer), F.lit(0)))
    placed = dated.join(F.broadcast(days.where(F.col("_newer") <= most_bytes)), "_day")
    upto = Window.partitionBy("_day").orderBy(F.desc(touched), *ties).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("_upto", F.col("_newer") + F.sum(size).over(upto)).where(F.col("_upto") <= most_bytes).drop("_day", "_bytes", "_newer", "_upto")


def engine_health(log: DataFrame) -> DataFrame:
    """log (engine, at, seq, ok, latency, reason): of each engine its counts, failures since the last success, and when its cool-down ends.

    The last success is a maximum, so no engine's history is gathered in one task.
    """
    order = F.struct("at", "seq")
    good = log.where("ok").groupBy("engine").agg(F.max(order).alias("last_ok"))
    totals = log.groupBy("engine").agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.sum("latency").alias("latency_sum"), F.count("*").alias("n"))
    since = log.join(good, "engine", "left").where(~F.col("ok") & (F.col("last_ok").isNull() | (order > F.col("last_ok"))))
    tail = since.groupBy("engine").agg(F.count("*").alias("consecutive"), F.max_by(F.struct("at", "reason"), order).alias("last"))
    out = totals.join(tail, "engine", "left").withColumn("consecutive", F.coalesce("consecutive", F.lit(0)))
    patient = F.col("engine") == PATIENT_ENGINE
    pause = F.when(patient, PATIENT_COOLDOWN).when(F.col("last.reason") == "connection", COOLDOWN_CONNECTION).otherwise(COOLDOWN)
    until = F.when(F.col("consecutive") >= F.when(patient, PATIENT_BLOCK_AFTER).otherwise(BLOCK_AFTER), F.timestamp_seconds(F.unix_timestamp("last.at") + pause))
    return out.select("engine", "successes", "failures", "consecutive", "latency_sum", "n", F.col("last.reason").alias("last_reason"), until.alias("blocked_until"))


def reliability(health: DataFrame) -> DataFrame:
    """Share of successes less a tenth at most for slowness; one half without a history."""
    share = F.col("successes") / F.nullif(F.col("successes") + F.col("failures"), F.lit(0))
    slow = F.least(F.col("latency_sum") / F.nullif(F.col("n"), F.lit(0)) / 10_000, F.lit(0.1))
    return health.withColumn("reliability", F.round(F.coalesce(share - slow, F.lit(0.5)), 9))


#: Successes after which the rungs are tried again from the cheapest, days after which a domain is forgotten, and the domains that are remembered.
PROBE_AFTER, STRATEGY_DAYS, MOST_DOMAINS = 10, 7, 500
#: Seconds that a service which gives no time is left alone.
LATCH_SECONDS = 600


def strategy_memory(log: DataFrame) -> DataFrame:
    """log (domain, at, seq, rung, ok): of each domain the cheapest rung that worked, successes since it was last tried from the cheapest, whether that is due, failures in a row by rung, and when.

    After seven days without an event a domain starts anew. One that starts with a failure remembers rung 0. Each state is a running
    minimum or a count since an event, so a domain is a few windows over its events; all have the same partitioning.
    """
    by = Window.partitionBy("domain").orderBy("at", "seq")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = log.select("domain", "at", "seq", "rung", "ok").dropDuplicates(["domain", "at", "seq"])
    late = F.unix_micros("at") - F.unix_micros(F.lag("at").over(by)) > STRATEGY_DAYS * 86_400_000_000
    rows = rows.withColumn("life", F.sum(F.when(F.coalesce(late, F.lit(False)), 1).otherwise(0)).over(upto))
    rows = rows.withColumn("last_life", F.max("life").over(Window.partitionBy("domain"))).where("life = last_life")
    rows = rows.withColumn("best", F.min(F.when(F.col("ok"), F.col("rung")).otherwise(F.when(F.row_number().over(by) == 1, 0))).over(upto))
    # a cheaper rung that works begins anew; so the last such event bounds all counts
    begun = F.max(F.when(F.coalesce(F.col("best") != F.lag("best").over(by), F.lit(True)), F.struct("at", "seq"))).over(Window.partitionBy("domain"))
    rows = rows.withColumn("begun", begun).where(F.struct("at", "seq") >= F.col("begun"))
    good = rows.where("ok").groupBy("domain", "rung").agg(F.max(F.struct("at", "seq")).alias("good"))
    bad = rows.where("not ok").join(good, ["domain", "rung"], "left").where(F.col("good").isNull() | (F.struct("at", "seq") > F.col("good")))
    bad = bad.groupBy("domain", "rung").agg(F.count("*").alias("n"))
    bad = bad.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("rung").cast("string"), F.col("n").cast("string")))), ",").alias("failures"))
    counts = rows.groupBy("domain").agg(F.max_by("best", F.struct("at", "seq")).alias("rung"), F.count_if("ok").alias("n"), F.max("at").alias("updated"))
    probe = (F.col("n") > 0) & (F.col("n") % PROBE_AFTER == 0)
    return counts.join(bad, "domain", "left").select("domain", "rung", (F.col("n") % PROBE_AFTER).cast("int").alias("successes"), probe.alias("probe"), F.coalesce("failures", F.lit("")).alias("failures"), "updated")


def remembered_domains(memory: DataFrame, now: Column, most: int = MOST_DOMAINS) -> DataFrame:
    """``strategy_memory`` as it is stored: domains with an event in the last seven days, of these the ``most`` that had one last."""
    fresh = memory.where(F.col("updated") >= now - F.make_dt_interval(F.lit(STRATEGY_DAYS)))
    return evict_oldest(fresh, "updated", most, "domain")


def latched(ops: DataFrame) -> DataFrame:
    """ops (service, at, seq, op, seconds): of each request whether the service had not said ``limited`` within its pause before; the last word counts."""
    before = Window.partitionBy("service").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    until = F.when(F.col("op") == "limited", F.timestamp_micros(F.unix_micros("at") + 1_000_000 * F.coalesce(F.col("seconds"), F.lit(LATCH_SECONDS)).cast("long")))
    rows = ops.withColumn("until", F.last(until, ignorenulls=True).over(before)).where("op = 'request'")
    return rows.select("service", "at", "seq", (F.col("until").isNull() | (F.col("at") >= F.col("until"))).alias("passed"))


def cache_answers(ops: DataFrame, ttl_seconds: int = 1800) -> DataFrame:
    """ops (name, at, seq, op, value): of each get whether the last put or drop before it was a put at most ``ttl_seconds`` ago, and its value."""
    before = Window.partitionBy("name").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") != "get", F.struct("op", "at", "value")), ignorenulls=True).over(before)
    rows = ops.withColumn("last", last).where("op = 'get'")
    hit = F.coalesce((F.col("last.op") == "put") & (F.unix_micros("at") - F.unix_micros("last.at") <= ttl_seconds * 1_000_000), F.lit(False))
    return rows.select("name", "at", "seq", hit.alias("hit"), F.when(hit, F.col("last.value")).alias("value"))


def queue_state(ops: DataFrame, tries: int = 3) -> DataFrame:
    """ops (url, path, seq, op): one entry for each path with its status, and how often it was added again.

    The last operation but ``add`` decides: to add what is there already counts as a duplicate and changes nothing.
    """
    failed, again = F.count_if(F.col("op") == "fail").alias("retries"), F.greatest(F.count_if(F.col("op") == "add") - 1, F.lit(0)).alias("duplicates")
    last = ops.groupBy("path").agg(F.min_by("url", "seq").alias("url"), failed, again, F.max_by("op", F.when(F.col("op") != "add", F.col("seq"))).alias("op"))
    status = (
        F.when(F.col("op") == "complete", "completed").when((F.col("op") == "fail") & (F.col("retries") >= tries), "failed").when(F.col("op") == "next", "in_progress").otherwise("queued")
    )
    return last.select("path", "url", "retries", "duplicates", status.alias("status"))


def queue_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("queued", "in_progress", "completed", "failed")), F.count("*").alias("total"))


def not_yet_written(discovered: DataFrame, written: DataFrame, key: str) -> DataFrame:
    return discovered.join(written.select(key), key, "left_anti")


def due_for_revalidation(rows: DataFrame, now: Column) -> DataFrame:
    """Expired entries that a server can confirm without sending them again."""
    return rows.where((F.col("expires_at") <= now) & (F.col("etag").isNotNull() | F.col("last_modified").isNotNull()))


def arrived_in_time(rows: DataFrame, arrived_ms: str, deadline_ms: int) -> DataFrame:
    return rows.where(F.col(arrived_ms) <= deadline_ms)


def token_bucket(requests: DataFrame, burst: int = 10, per_second: int = 5) -> DataFrame:
    """requests (host, second): how many of each host's seconds pass a bucket that refills in whole-second steps.

    Requests are counted by second first. A bucket is full again after a pause in which all its tokens come back, so a host's seconds
    fall into stretches between such pauses, and a thousand stretches are a pass of their own.
    """
    refill = -(-burst // per_second)
    counted = requests.groupBy("host", "second").agg(F.count("*").alias("asked"))
    by = Window.partitionBy("host").orderBy("second")
    new = F.coalesce(F.col("second") - F.lag("second").over(by) >= refill, F.lit(True))
    stretches = counted.withColumn("stretch", F.floor(F.sum(new.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) / 1000))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, tokens, at, passed = rows.sort_values("second"), burst, None, []
        for second, asked in zip(rows["second"].tolist(), rows["asked"].tolist(), strict=True):
            tokens = min(burst, tokens + (0 if at is None else (second - at) * per_second))
            passed.append(min(tokens, asked))
            tokens, at = tokens - passed[-1], second
        return rows.assign(passed=passed)[["host", "second", "asked", "passed"]]

    host = dict(counted.dtypes)["host"]
    return stretches.groupBy("host", "stretch").applyInPandas(run, f"host {host}, second long, asked long, passed long")


def scorecard(runs: DataFrame, by: str) -> DataFrame:
    """runs (by, ok, hit, tokens, ms): rates, and percentiles that are a value of the sorted list."""
    # The value at index floor(n * p): percentile_disc of the fraction just past that many rows.
    at = lambda c, p: F.expr(f"percentile_disc({p} + 1e-9) within group (order by {c})")
    return runs.groupBy(by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("ok").cast("int")), 9).alias("success_rate"),
        F.round(F.avg(F.col("hit").cast("int")), 9).alias("hit_rate"),
        at("tokens", 0.5).alias("median_tokens"),
        at("ms", 0.5).alias("p50"),
        at("ms", 0.95).alias("p95"),
    )
