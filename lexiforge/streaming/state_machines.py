"""Streaming twins of the state in ``operators.state``: engine health, crawl queue, windows over outcomes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiforge.operators.state import BLOCK_AFTER, COOLDOWN, COOLDOWN_CONNECTION, PATIENT_BLOCK_AFTER, PATIENT_COOLDOWN, PATIENT_ENGINE, STRATEGY_DAYS

_HEALTH = "engine string, successes long, failures long, consecutive long, blocked_until timestamp"


def _health(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    good, bad, run, until = state.get if state.exists else (0, 0, 0, None)
    patient = key[0] == PATIENT_ENGINE
    for rows in batches:
        for r in rows.sort_values(["at", "seq"]).itertuples():
            if r.ok:
                good, run, until = good + 1, 0, None
            else:
                bad, run = bad + 1, run + 1
                if run >= (PATIENT_BLOCK_AFTER if patient else BLOCK_AFTER):
                    until = int(r.at.timestamp()) + (PATIENT_COOLDOWN if patient else COOLDOWN_CONNECTION if r.reason == "connection" else COOLDOWN)
    state.update((good, bad, run, until))
    when = pd.Timestamp(until, unit="s") if until is not None else pd.NaT
    yield pd.DataFrame({"engine": [key[0]], "successes": [good], "failures": [bad], "consecutive": [run], "blocked_until": [when]})


def engine_health_stream(log: DataFrame) -> DataFrame:
    """log (engine, at, seq, ok, reason), a stream: each engine's health after every batch (update mode).

    A success resets the run of failures; two in a row block the engine for a while.
    """
    return log.groupBy("engine").applyInPandasWithState(_health, _HEALTH, "good long, bad long, run long, until long", "update", GroupStateTimeout.NoTimeout)


_QUEUE = "path string, url string, retries long, status string"


def _queue(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    url, retries, status = state.get if state.exists else (None, 0, "queued")
    for rows in batches:
        for r in rows.sort_values("seq").itertuples():
            url = url or r.url
            if r.op == "add":  # what is there already stays as it is
                continue
            if r.op == "fail":
                retries += 1
            status = {"next": "in_progress", "complete": "completed"}.get(r.op, "failed" if r.op == "fail" and retries >= 3 else "queued")
    state.update((url, retries, status))
    yield pd.DataFrame({"path": [key[0]], "url": [url], "retries": [retries], "status": [status]})


def queue_stream(ops: DataFrame) -> DataFrame:
    """ops (path, url, seq, op), a stream: each entry's status after every batch (update mode)."""
    return ops.groupBy("path").applyInPandasWithState(_queue, _QUEUE, "url string, retries long, status string", "update", GroupStateTimeout.NoTimeout)


def outcome_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """events (ts, engine, ok, latency), a stream or a table: outcomes by window; rows later than ``late`` are dropped."""
    window = F.window("ts", size)
    counted = events.withWatermark("ts", late).groupBy(window, "engine").agg(F.count("*").alias("n"), F.count_if("ok").alias("good"), F.sum("latency").alias("latency"))
    return counted.select(F.col("window.start").alias("start"), "engine", "n", "good", "latency")


def remembered(strategies: DataFrame, now: Column) -> DataFrame:
    """``strategies`` (domain, rung, updated) that still count: updated at most seven days before ``now``, or at no known time."""
    fresh = F.col("updated") >= now - F.make_dt_interval(F.lit(STRATEGY_DAYS))
    return strategies.where(F.coalesce(fresh, F.lit(True)))
