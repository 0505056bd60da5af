"""State machines on streams that see each key's events in the order of their times, once each, and forget.

A batch of a stream brings events late, twice and in any order. What a machine has not seen yet waits in a map by (time, seq), so a
repeated row finds itself there; an event-time timer at each event's time fires when the watermark has passed it, and only then the
machine takes the events up to that time, in order. So the rows that come out are those of the same machine over the whole table
sorted by key, time and seq, whatever the batches were; rows later than the watermark are dropped. ``ttl`` after its last event a key's
state goes: its timer removes it, and a row says so. A key without state costs nothing.

``initial`` gives keys a state to begin with, from a batch table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Fold = Callable[[dict | None, dict], tuple[dict | None, dict | None]]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """Streams with timers keep their state in RocksDB: set before such a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Ordered(StatefulProcessor):
    """``fold``: (state or None, event) gives the state after it and a row to put out, or None. ``forgotten``: the row when a key's state goes."""

    def __init__(self, fold: Fold, columns: list[str], ttl_ms: int | None, forgotten: dict | None):
        self.fold, self.columns, self.ttl_ms, self.forgotten = fold, columns, ttl_ms, forgotten

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "state string, at_ms long")
        self.waiting = handle.getMapState("waiting", "at_ms long, seq long", "event string")

    def _rows(self, key: tuple, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([{"key": key[0], **r} for r in rows], columns=["key", *self.columns])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, wake = timerValues.getCurrentWatermarkInMs(), set()
        for batch in rows:
            for r in batch.to_dict("records"):
                at_ms, seq = int(r["at_ms"]), int(r["seq"])
                if at_ms <= passed:  # later than the watermark allows
                    continue
                self.waiting.updateValue((at_ms, seq), (r["event"],))
                wake.add(at_ms)
        for at_ms in wake:
            self.handle.registerTimer(at_ms)
        yield from ()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState.iloc[0]
        self._keep(json.loads(r["state"]), int(r["at_ms"]))

    def _keep(self, state: dict | None, at_ms: int) -> None:
        if state is None:
            self.known.clear()
            return
        self.known.update((json.dumps(state), at_ms))
        if self.ttl_ms is not None:
            self.handle.registerTimer(at_ms + self.ttl_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        state, last = (None, None)
        if self.known.exists():
            stored, last = self.known.get()
            state = json.loads(stored)
        out, changed = [], False
        due = sorted((tuple(k), v[0]) for k, v in self.waiting.iterator() if k[0] <= now)
        for (at_ms, seq), event in due:
            if state is not None and self.ttl_ms is not None and at_ms > last + self.ttl_ms:
                state = None
            state, row = self.fold(state, {**json.loads(event), "at_ms": at_ms, "seq": seq})
            last, changed = at_ms, True
            self.waiting.removeKey((at_ms, seq))
            if row is not None:
                out.append({"at_ms": at_ms, "seq": seq, **row})
        if not due and state is not None and self.ttl_ms is not None and now > last + self.ttl_ms:
            state, changed = None, True
            if self.forgotten is not None:
                out.append({"at_ms": now, "seq": -1, **self.forgotten})
        if changed:
            self._keep(state, last)
        yield from self._rows(key, out)


def in_order(events: DataFrame, key: str, at: str, seq: str, fold: Fold, columns: str, late: str = "10 minutes", ttl_ms: int | None = None, forgotten: dict | None = None, initial: DataFrame | None = None) -> DataFrame:
    """key, at_ms, seq and ``columns`` (DDL) that ``fold`` puts out for the rows of a stream, in update mode.

    ``at`` is a timestamp, ``seq`` a long that tells the events of one time apart; (key, at, seq) is an event's identity. All
    other columns of ``events`` are its content. ``initial``: key, state (JSON), at_ms.
    """
    rest = [c for c in events.columns if c not in (key, at, seq)]
    rows = events.withWatermark(at, late).select(F.col(key).cast("string").alias("key"), F.col(at), F.unix_millis(at).alias("at_ms"), F.col(seq).cast("long").alias("seq"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("event"))
    names = ["at_ms", "seq", *(c.strip().split()[0] for c in columns.split(","))]
    start = None if initial is None else initial.select(F.col("key").cast("string").alias("key"), "state", F.col("at_ms").cast("long").alias("at_ms")).groupBy("key")
    with_state_store(events.sparkSession)
    return rows.groupBy("key").transformWithStateInPandas(Ordered(fold, names, ttl_ms, forgotten), f"key string, at_ms long, seq long, {columns}", "Update", "EventTime", start)


def replay(events: DataFrame, key: str, at: str, seq: str, fold: Fold, columns: str, ttl_ms: int | None = None) -> DataFrame:
    """The same rows over a table, by one pass over each key's events: what a stream of them comes to, but for the rows of ``forgotten``."""
    rest = [c for c in events.columns if c not in (key, at, seq)]
    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_millis(at).alias("at_ms"), F.col(seq).cast("long").alias("seq"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("event"))
    names = ["at_ms", "seq", *(c.strip().split()[0] for c in columns.split(","))]

    def run(found: tuple, group: pd.DataFrame) -> pd.DataFrame:
        state, last, out = None, None, []
        for at_ms, n, event in group.drop_duplicates(["at_ms", "seq"]).sort_values(["at_ms", "seq"])[["at_ms", "seq", "event"]].itertuples(index=False):
            if state is not None and ttl_ms is not None and at_ms > last + ttl_ms:
                state = None
            state, row = fold(state, {**json.loads(event), "at_ms": at_ms, "seq": n})
            last = at_ms
            if row is not None:
                out.append({"key": found[0], "at_ms": at_ms, "seq": n, **row})
        return pd.DataFrame(out, columns=["key", *names])

    return rows.groupBy("key").applyInPandas(run, f"key string, at_ms long, seq long, {columns}")
