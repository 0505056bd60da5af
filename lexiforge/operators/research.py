"""Evidence, stance and verdict of sources about a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import round_half_up, terms

#: Words that speak against a claim.
CONFLICT_MARKERS = [
    "false", "debunked", "debunks", "denied", "denies", "deny", "no evidence", "lacks evidence", "no proof", "retracted", "retraction", "myth",
    "disproven", "disproved", "disputed", "refuted", "refutes", "refute", "unfounded", "baseless", "misleading", "hoax", "fabricated", "fake",
    "incorrect", "inaccurate", "unsubstantiated", "contradicts", "contradicted", "contrary to", "not true", "not supported", "unproven",
    "discredited", "misinformation", "disinformation", "overstated", "exaggerated", "unverified", "rebutted", "rebuts", "withdrawn", "recanted",
    "invalidated", "erroneous",
]
MARKER_PATTERN = r"\b(" + "|".join(m.replace(" ", r"[ \t\n\r]+") for m in CONFLICT_MARKERS) + r")\b"
NEUTRAL_BELOW, SUPPORT_FROM, PRIMARY_FACTOR = 0.15, 0.3, 1.3
STRONG_SCORE, STRONG_COUNT, DOMINANCE = 1.2, 2, 1.5
#: Answers that mean a page is guarded, not gone.
GUARDED_STATUS = [401, 403, 405, 406, 409, 429, 999]
GUARDED_CODES = ["bot_detected", "blocked", "paywall", "rate_limited", "auth_required"]


def markers(text: Column) -> Column:
    """Conflict markers of a text, in lower case, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(MARKER_PATTERN), 1)


def spaced(low: Column) -> Column:
    """A text in lower case with one space for each stretch of other characters; its words are picked out, which takes a quarter of the time of replacing what is between them."""
    found = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), 0)
    edge = lambda c: F.when(c.rlike("^[^a-z0-9_]"), " ").otherwise("")
    return F.transform(F.array(found), lambda w: F.when((F.size(w) == 0) & (low != ""), " ").otherwise(F.concat(edge(low), F.array_join(w, " "), edge(F.right(low, F.lit(1))))))[0]


def overlap(query: Column, text: Column) -> Column:
    """The share of the query's terms (with repeats) that the text has as words."""
    low = F.concat(F.lit(" "), spaced(F.lower(F.coalesce(text, F.lit("")))), F.lit(" "))
    # one array of one pair: both sides are computed once a row, not once for each term
    pair = F.array(F.struct(terms(query).alias("asked"), low.alias("low")))
    present = lambda p: F.filter(p["asked"], lambda t: F.contains(p["low"], F.concat(F.lit(" "), F.regexp_replace(t, "-", " "), F.lit(" "))))
    share = lambda p: F.when(F.size(p["asked"]) == 0, 0.0).otherwise(F.size(present(p)) / F.size(p["asked"]))
    return F.when(F.trim(text) == "", 0.0).otherwise(F.transform(pair, share)[0])


def freshness(published: Column, now: Column) -> Column:
    age = (F.unix_timestamp(now) - F.unix_timestamp(published)) / 86400
    return F.when(age.isNull() | (age < 0), 0.5).when(age <= 365, 1.0).when(age <= 3 * 365, 0.7).when(age <= 7 * 365, 0.4).otherwise(0.2)


def stance(rows: DataFrame, now: Column) -> DataFrame:
    """rows (query, text, primary, published): label, keyword_overlap, conflict_markers, freshness, strength."""
    found = rows.withColumns({"overlap": overlap(F.col("query"), F.col("text")), "found": markers(F.col("text")), "freshness": freshness(F.col("published"), now)})
    count = F.size("found")
    label = (
        F.when(F.col("overlap") < NEUTRAL_BELOW, "neutral").when(count > 0, "conflicting").when(F.col("overlap") >= SUPPORT_FROM, "supporting").otherwise("neutral")
    )
    magnitude = (F.col("overlap") * 0.6 + F.col("freshness") * 0.4) * F.when(F.col("primary"), PRIMARY_FACTOR).otherwise(1.0)
    against = -round_half_up(magnitude * (0.5 + F.least(F.lit(1.0), count * 0.15)))
    found = found.withColumns({"label": label, "conflict_markers": count})
    strength = F.when(F.col("label") == "supporting", round_half_up(magnitude)).when(F.col("label") == "conflicting", against).otherwise(0.0)
    return found.withColumns({"strength": strength, "keyword_overlap": round_half_up(F.col("overlap")), "markers": F.array_sort(F.array_distinct("found"))}).drop("overlap", "found")


def verdicts(stances: DataFrame) -> DataFrame:
    """One row for each query: counts, scores and a categorical verdict."""
    s = stances.groupBy("query").agg(
        F.count_if(F.col("label") == "supporting").alias("supporting"),
        F.count_if(F.col("label") == "conflicting").alias("conflicting"),
        F.count_if(F.col("label") == "neutral").alias("neutral"),
        round_half_up(F.sum(F.greatest("strength", F.lit(0.0)))).alias("support_score"),
        round_half_up(-F.sum(F.least("strength", F.lit(0.0)))).alias("conflict_score"),
    )
    strong = lambda score, n: (F.col(score) >= STRONG_SCORE) & (F.col(n) >= STRONG_COUNT)
    verdict = (
        F.when((F.col("supporting") == 0) & (F.col("conflicting") == 0), "insufficient_evidence")
        .when(F.col("conflicting") == 0, F.when(strong("support_score", "supporting"), "supported").otherwise("likely_supported"))
        .when(F.col("supporting") == 0, F.when(strong("conflict_score", "conflicting"), "likely_false").otherwise("contested"))
        .when(F.col("support_score") > F.col("conflict_score") * DOMINANCE, "likely_supported")
        .when(F.col("conflict_score") > F.col("support_score") * DOMINANCE, "likely_false")
        .otherwise("contested")
    )
    return s.withColumn("verdict", verdict)


def reachability(ok: Column, status: Column, code: Column) -> Column:
    return (
        F.when(ok, "ok").when(status.isin(GUARDED_STATUS) | code.isin(GUARDED_CODES), "skipped").when(status.isNull() & (F.coalesce(code, F.lit("")) == ""), "unknown").otherwise("dead")
    )


def best_evidence(chunks: DataFrame, most: int = 700) -> DataFrame:
    """chunks (source, chunk, text, score): the best chunk of each source as a quote; the first on ties."""
    order = Window.partitionBy("source").orderBy(F.desc("score"), "chunk")
    return chunks.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("source", "chunk", F.substring("text", 1, most).alias("quote"), "score")


def citation_audit(ranked: DataFrame, fetched: DataFrame) -> DataFrame:
    """ranked (id, url, primary) with what became of fetching it (url, ok, status, code); sources never fetched are unknown."""
    joined = ranked.join(fetched, "url", "left")
    return joined.withColumn("reachability", F.when(F.col("ok").isNull(), "unknown").otherwise(reachability(F.col("ok"), F.col("status"), F.col("code"))))
