"""Stored content and results: looking them up, many at a time, and sweeping what is old or too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import content_hash, short_hash
from lexiforge.operators.sections import section_diff, sections

#: What of a result is shown, how many are named when none is found, and limits of the sweep.
MOST_SHOWN, RECENT = 50_000, 5
SWEEP_DAYS, SWEEP_BYTES, GRACE_SECONDS, MOST_FILES = 7, 500 << 20, 300, 20_000


def content_for(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """asked (url) with found, title, content, length, hash, unchanged and text: the newest version of each page.

    ``versions``: url, at, title, content. A page without a version has found false and says so. ``unchanged``: whether the version
    before it was the same; null without one.
    """
    by = Window.partitionBy("url").orderBy("at")
    rows = versions.withColumn("previous", F.lag("content").over(by)).withColumn("n", F.row_number().over(by)).withColumn("last", F.max("n").over(Window.partitionBy("url"))).where("n = last")
    rows = rows.select("url", "title", "content", "previous", (F.col("n") > 1).alias("again"), F.lit(True).alias("_found"))
    both = asked.join(rows, "url", "left").withColumn("found", F.coalesce("_found", F.lit(False)))
    same = F.when(F.col("again"), F.coalesce(content_hash(F.col("content")) == content_hash(F.col("previous")), F.lit(False)))
    digest = short_hash(F.col("content"))
    head = F.concat_ws(
        "\n", F.concat(F.lit("Retrieved content for "), "url"), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("Title: "), "title")),
        F.concat(F.lit("Length: "), F.length(F.coalesce("content", F.lit(""))).cast("string"), F.lit(" chars")), F.concat(F.lit("Content hash: "), digest),
        F.when(same, F.concat(F.lit("Unchanged since previous version ("), short_hash(F.col("previous")), F.lit(")"))),
    )
    text = F.when(F.col("found"), F.concat(head, F.lit("\n\n---\n\n"), F.coalesce("content", F.lit("")))).otherwise(F.concat(F.lit("No stored content found for "), "url"))
    return both.withColumns({"unchanged": same, "hash": F.when(F.col("found"), digest), "length": F.when(F.col("found"), F.length(F.coalesce("content", F.lit("")))), "text": text}).select(*asked.columns, "found", "title", "content", "length", "hash", "unchanged", "text")


def changes_of(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """url, key and change of the sections in which the newest version of each page differs from the one before it; pages with one version have no row."""
    by = Window.partitionBy("url").orderBy(F.desc("at"))
    rows = versions.join(asked.select("url").distinct(), "url", "left_semi").withColumn("back", F.row_number().over(by)).where(F.col("back") <= 2)
    pages = rows.withColumn("both", F.max("back").over(Window.partitionBy("url"))).where("both = 2")
    new, old = (sections(pages.where(F.col("back") == k), "url", "content") for k in (1, 2))
    return section_diff(old, new).withColumnRenamed("doc_id", "url")


def results_for(asked: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """asked (id) with found and text: each result, or else the newest ones that there are.

    ``results``: id, url, source, content, created_at, expires_at (seconds; 0 never expires).
    """
    alive = results.where((F.col("expires_at") == 0) | (F.col("expires_at") > now))
    newest = alive.orderBy(F.desc("created_at"), "id").limit(RECENT).collect()  # RECENT rows
    recent = "\n".join(f"  - {r['id']}: {r['url']} ({r['source']})" for r in newest) or "  (none)"
    both = asked.join(alive.withColumn("_found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("_found", F.lit(False)))
    body = F.coalesce("content", F.lit(""))
    shown = F.when(F.length(body) > MOST_SHOWN, F.concat(F.substring(body, 1, MOST_SHOWN), F.lit("\n\n[... truncated]"))).otherwise(body)
    text = F.concat(F.lit("Retrieved result "), "id", F.lit("\nURL: "), "url", F.lit("\nTool: "), "source", F.lit("\nLength: "), F.length(body).cast("string"), F.lit(" chars\n\n---\n\n"), shown)
    none = F.concat(F.lit("No result found for ID: "), "id", F.lit("\n\nRecent results:\n" + recent))
    return both.select(*asked.columns, "found", F.when(F.col("found"), text).otherwise(none).alias("text"))


def swept(entries: DataFrame, now: Column, most_bytes: int = SWEEP_BYTES, days: int = SWEEP_DAYS, block: int = 86_400) -> DataFrame:
    """``entries`` (path, modified in seconds, bytes, files) with outcome: active, expired, capped or kept.

    What was changed in the last five minutes is left alone and counts for nothing; what is older than ``days`` goes; of the rest
    the oldest go until what is left has at most ``most_bytes``. An entry of too many files to count is as large as the cap and
    one byte. Bytes are summed by day first, so only the entries of one day are looked at in order.
    """
    age = now - F.col("modified")
    rows = entries.withColumn("_size", F.when(F.col("files") > MOST_FILES, F.greatest("bytes", F.lit(most_bytes + 1))).otherwise(F.col("bytes")).cast("long"))
    rows = rows.withColumn("outcome", F.when(age < GRACE_SECONDS, "active").when(age > days * 86_400, "expired")).withColumn("_day", F.floor(F.col("modified") / block))
    left = rows.where("outcome is null")
    per_day = left.groupBy("_day").agg(F.sum("_size").alias("_total"))
    newer = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each day of a week
    per_day = per_day.select("_day", F.coalesce(F.sum("_total").over(newer), F.lit(0)).alias("_newer"))
    within = Window.partitionBy("_day").orderBy(F.desc("modified"), F.desc("path")).rowsBetween(Window.unboundedPreceding, 0)
    placed = left.join(per_day, "_day").withColumn("_upto", F.col("_newer") + F.sum("_size").over(within))
    capped = placed.withColumn("outcome", F.when(F.col("_upto") > most_bytes, "capped").otherwise("kept"))
    return rows.where("outcome is not null").select(*entries.columns, "outcome").unionByName(capped.select(*entries.columns, "outcome"))


def summary_key(url: Column, focus: Column) -> Column:
    """Under what a summary is kept: the address, and what it was asked for without regard to case and spaces."""
    said = F.trim(F.regexp_replace(F.lower(F.coalesce(focus, F.lit(""))), r"\s+", " "))
    return F.when(said == "", url).otherwise(F.concat(url, F.lit("\x00"), said))


def result_id(*parts: Column) -> Column:
    """Twelve letters of a hash of what makes a result one."""
    return F.substring(F.sha2(F.concat_ws("\x00", *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, 12)
