"""What a crawler remembers, on streams: the rung that works for a domain, a rate-limited service, cached values.

Each is a small machine for ``ordered.in_order``. Batch twins over whole tables are in ``operators.state``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.state import LATCH_SECONDS, PROBE_AFTER, STRATEGY_DAYS
from lexiforge.streaming.ordered import in_order

DAY_MS = 86_400_000


def strategy(state: dict | None, event: dict) -> tuple[dict, dict]:
    """The cheapest rung that worked; whether all rungs should be tried again from the cheapest; failures in a row by rung."""
    rung = str(event["rung"])
    if state is None:
        state = {"rung": event["rung"] if event["ok"] else 0, "successes": 0, "probe": False, "failures": {}}
    if not event["ok"]:
        state["failures"][rung] = state["failures"].get(rung, 0) + 1
    elif event["rung"] < state["rung"]:
        state = {"rung": event["rung"], "successes": 1, "probe": False, "failures": {}}
    else:
        n = state["successes"] + 1
        state["probe"], state["successes"] = n >= PROBE_AFTER, 0 if n >= PROBE_AFTER else n
        state["failures"].pop(rung, None)
    return state, {"rung": state["rung"], "successes": state["successes"], "probe": state["probe"], "failures": ",".join(f"{k}:{n}" for k, n in sorted(state["failures"].items()))}


def strategy_memory_stream(log: DataFrame, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """log (domain, at, seq, rung, ok): after each event what is known of the domain; a row without a rung when seven days have passed."""
    nothing = {"rung": None, "successes": 0, "probe": False, "failures": ""}
    columns = "rung int, successes int, probe boolean, failures string"
    return in_order(log.select("domain", "at", "seq", "rung", "ok"), "domain", "at", "seq", strategy, columns, late, STRATEGY_DAYS * DAY_MS, nothing, initial).withColumnRenamed("key", "domain")


def known_strategies(memory: DataFrame) -> DataFrame:
    """The result of ``operators.state.strategy_memory`` as the state that ``strategy_memory_stream`` begins with."""
    failures = F.when(F.col("failures") == "", F.create_map().cast("map<string,int>")).otherwise(F.transform_values(F.str_to_map("failures", F.lit(","), F.lit(":")), lambda _, n: n.cast("int")))
    state = F.to_json(F.struct("rung", "successes", "probe", failures.alias("failures")))
    return memory.select(F.col("domain").alias("key"), state.alias("state"), F.unix_millis("updated").alias("at_ms"))


def latch(state: dict | None, event: dict) -> tuple[dict | None, dict | None]:
    """A request is let through unless the service said less than its pause ago that it is too much; the last word counts."""
    if event["op"] == "limited":
        return {"until_ms": event["at_ms"] + 1000 * (LATCH_SECONDS if event["seconds"] is None else event["seconds"])}, None
    open_ = state is None or event["at_ms"] >= state["until_ms"]
    return state, {"passed": open_}


def latch_stream(ops: DataFrame, late: str = "10 minutes") -> DataFrame:
    """ops (service, at, seq, op: limited or request, seconds): for each request whether it passed. A service's state goes a day after its last event."""
    return in_order(ops.select("service", "at", "seq", "op", "seconds"), "service", "at", "seq", latch, "passed boolean", late, DAY_MS).withColumnRenamed("key", "service")


def cache(ttl_ms: int):
    """Puts, gets and drops of one key: a get finds the value that was put at most ``ttl_ms`` before."""

    def step(state: dict | None, event: dict) -> tuple[dict | None, dict | None]:
        if event["op"] == "put":
            return {"value": event["value"], "put_ms": event["at_ms"]}, None
        if event["op"] == "drop":
            return None, None
        hit = state is not None and event["at_ms"] - state["put_ms"] <= ttl_ms
        return state if hit else None, {"hit": hit, "value": state["value"] if hit else None}

    return step


def cache_stream(ops: DataFrame, ttl_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """ops (name, at, seq, op: put, get or drop, value): for each get whether it hit, and the value. An entry's state goes when it has expired."""
    ttl = 1000 * ttl_seconds
    return in_order(ops.select("name", "at", "seq", "op", "value"), "name", "at", "seq", cache(ttl), "hit boolean, value string", late, ttl).withColumnRenamed("key", "name")
