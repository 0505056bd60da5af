"""Data that pages carry for their scripts: JSON scripts, assigned globals and streamed components, down to their leaves.

Scripts come from ``elements`` rows. An assigned object is cut out by a scan that knows braces and strings, so nested ones are
whole. Values become rows level by level: a VARIANT is exploded, what holds more goes to the next level.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexiforge.sources.work import stored

#: Types of JSON scripts, ids of scripts that hold JSON whatever their type, and globals that servers assign.
JSON_TYPES = ["application/json", "application/ld+json", "text/json"]
SCRIPT_IDS = """__NEXT_DATA__ __NUXT_DATA__ __GATSBY_DATA__ __REMIX_DATA__ __APOLLO_STATE__ __INITIAL_STATE__ __PRELOADED_STATE__ __DATA__ __SHOPIFY_SDA__
bootstrap-data initial-state app-data server-data hydration-data page-props""".split()
GLOBALS = """__DATA__ __INITIAL_STATE__ __APOLLO_STATE__ __PRELOADED_STATE__ __NEXT_DATA__ __NUXT__ __GATSBY__ __SHOPIFY_SDA__ __remixContext __reactServerManifest
__remixRouteModules __vite_plugin_react_preamble_installed__ __sveltekit_ _env_ _data __store""".split()
STREAMED, MOST_STREAMED = "__next_f (RSC)", 20_000
#: The deepest level that is shown, and the entries of one value that are.
MOST_DEPTH, MOST_ITEMS = 3, 50
_ASSIGNED = re.compile(r"(?:window\.|(?:var|const|let)\s+)(" + "|".join(re.escape(g) + (r"\w+" if g.endswith("kit_") else "") for g in GLOBALS) + r")\s*=\s*(?=\{)")
_TOKEN = re.compile(r"[{}]|\"(?:[^\"\\]|\\.)*\"", re.S)


def balanced(text: str, start: int) -> str | None:
    """The object that begins with the brace at ``start``; None if it does not end."""
    depth = 0
    for m in _TOKEN.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return text[start : m.end()]
    return None


def assigned(text: str | None) -> list[dict]:
    """Name and object of each global that is assigned JSON, the first of each name."""
    found: dict[str, str] = {}
    for m in _ASSIGNED.finditer(text or ""):
        name = "__sveltekit_" if m[1].startswith("__sveltekit_") else m[1]
        if name not in found and (body := balanced(text, m.end())):
            try:
                json.loads(body)
            except ValueError:
                continue
            found[name] = body
    return [{"name": k, "json": v} for k, v in found.items()]


_ASSIGNMENTS = ArrayType(StructType([StructField("name", StringType()), StructField("json", StringType())]))


@F.pandas_udf(_ASSIGNMENTS)
def _assigned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        # few documents' results at a time, however many a batch has
        for k in range(0, len(texts), 100):
            yield texts[k : k + 100].map(assigned)


def islands(rows: DataFrame) -> DataFrame:
    """page, rank, source, json, size of each source of data in a page, the largest first; ``rows``: ``elements``."""
    scripts = rows.where("tag = 'script'").select("page", "place", "text", F.coalesce(F.col("attributes")["type"], F.lit("")).alias("type"), F.coalesce(F.col("attributes")["id"], F.lit("")).alias("id"))
    scripts = stored(scripts, "scripts")  # read for each kind of source
    typed = F.col("type").isin(JSON_TYPES)
    known = F.exists(F.array(*(F.lit(x.lower()) for x in SCRIPT_IDS)), lambda x: F.contains(F.lower("id"), x))
    name = F.when(F.col("id") != "", F.col("id")).otherwise(F.concat(F.lit('script[type="'), "type", F.lit('"]')))
    plain = scripts.where((typed | known) & F.try_parse_json("text").isNotNull()).select("page", F.lit(0).alias("kind"), "place", F.lit(0).alias("at"), name.alias("source"), F.col("text").alias("json"))
    code = scripts.where(~typed)
    named = code.where(F.col("text").rlike("__|_env_|_data")).select("page", "place", F.posexplode(_assigned("text")).alias("at", "a"))
    globals_ = named.select("page", F.lit(1).alias("kind"), "place", "at", F.col("a.name").alias("source"), F.col("a.json").alias("json"))
    pushed = code.select("page", "place", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)self\.__next_f\.push\((\[.*?\])\)"), 1)).alias("at", "push"))
    payload = F.coalesce(F.try_variant_get(F.try_parse_json("push"), "$[1]", "string"), F.lit(""))
    said = F.filter(F.split(payload, r'["\n]'), lambda s: (F.length(s) > 30) & s.rlike("[a-z]{3,}") & ~s.startswith("$") & ~s.startswith("@"))
    streamed = pushed.withColumn("said", said).where(F.size("said") > 0).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", "at", F.array_join("said", "\n\n").alias("s")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["s"]), "\n\n")
    streamed = streamed.select("page", F.lit(2).alias("kind"), F.lit(0).alias("place"), F.lit(0).alias("at"), F.lit(STREAMED).alias("source"), F.to_json(F.struct(F.substring(text, 1, MOST_STREAMED).alias("text"))).alias("json"))
    every = plain.unionByName(globals_).unionByName(streamed)
    one = every.groupBy("page", "source").agg(F.min_by(F.struct("kind", "place", "at", "json"), F.struct("kind", "place", "at")).alias("i")).select("page", "source", "i.*")
    size = F.length("json")
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("size"), "kind", "place", "at"))
    return one.withColumn("size", size).withColumn("rank", rank).select("page", "rank", "source", "json", "size")


def leaves(found: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """page, source, path, depth, kind, value of each leaf of ``found`` (page, source, json): values, and what lies deeper than ``most_depth`` as its kind and size."""
    found = stored(found.select("page", "source", "json"), "islands")  # read for each level
    level = found.select("page", "source", F.lit("$").alias("path"), F.lit("").alias("parent"), F.try_parse_json("json").alias("v")).where("v is not null")
    out = []
    for depth in range(most_depth + 2):
        typed = level.withColumn("shape", F.schema_of_variant("v"))
        shape = F.when(F.col("shape").startswith("OBJECT"), "object").when(F.col("shape").startswith("ARRAY"), "array").otherwise("value")
        typed = typed.withColumn("shape", F.when(F.is_variant_null("v"), "null").otherwise(shape))
        holds = F.col("shape").isin("object", "array")
        last = depth > most_depth
        value = F.when(holds, F.to_json("v")).when(F.col("shape") == "null", F.lit(None)).otherwise(F.try_variant_get("v", "$", "string"))
        out.append((typed if last else typed.where(~holds | F.to_json("v").isin("{}", "[]"))).select("page", "source", "path", F.lit(depth).alias("depth"), "parent", F.col("shape").alias("kind"), value.alias("value")))
        if last:
            break
        view = typed.where(holds)
        exploded = view.lateralJoin(found.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key"), F.col("value").alias("child")))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = exploded.select("page", "source", F.concat("path", step).alias("path"), F.col("shape").alias("parent"), F.col("child").alias("v"))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every


def best_island(found: DataFrame) -> DataFrame:
    """page, source, json and score of each page's most useful island: twice the text near its top, and its size; the larger one on ties."""
    near = leaves(found, 1).where("kind = 'value'")
    # strings at the top, and one below: of lists in an object, and of objects in a list
    strings = near.join(found.select("page", "source", F.schema_of_variant(F.try_parse_json("json")).startswith("ARRAY").alias("list")), ["page", "source"])
    counts = (F.col("depth") == 1) | ((F.col("depth") == 2) & (F.col("list") == (F.col("parent") == "object")))
    text = strings.where(counts & _is_string()).groupBy("page", "source").agg(F.sum(F.length("value")).alias("text"))
    scored = found.join(text, ["page", "source"], "left").withColumn("score", 2 * F.coalesce("text", F.lit(0)) + F.col("size"))
    return scored.groupBy("page").agg(F.max_by(F.struct("source", "json", "score"), F.struct("score", (-F.col("rank")).alias("first"))).alias("b")).select("page", "b.*")


def _is_string():
    return ~F.col("value").rlike(r"^(true|false|-?\d+(\.\d+)?([eE][-+]?\d+)?)$")


def shown(value, depth: int = 0) -> str:
    """A value as Markdown: names in bold, lists as items, what lies too deep by its kind."""
    if isinstance(value, dict | list) and depth > MOST_DEPTH:
        return f"`[array ×{len(value)}]`" if isinstance(value, list) else "`{object}`"
    if value is None:
        return "`null`"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return value[:2000]
    if isinstance(value, list):
        lines = [f"- {shown(x, depth + 1)}" for x in value[:MOST_ITEMS]]
        return "\n".join(lines + ([f"- _… and {len(value) - MOST_ITEMS} more_"] if len(value) > MOST_ITEMS else []))
    if isinstance(value, dict):
        lines = []
        for k, v in list(value.items())[:MOST_ITEMS]:
            body = shown(v, depth + 1)
            nested = "\n" in body and depth < MOST_DEPTH - 1
            lines.append(f"**{k}:**\n" + re.sub("(?m)^", "  ", body) if nested else f"**{k}:** {body}")
        return "\n".join(lines + ([f"_… and {len(value) - MOST_ITEMS} more keys_"] if len(value) > MOST_ITEMS else []))
    return str(value)


@F.pandas_udf(StringType())
def json_markdown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: shown(json.loads(t)), na_action="ignore")
