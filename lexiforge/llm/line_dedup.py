"""Line dedup: later copies of repeated runs of lines go. DataFrame functions only.

Every document is a sequence of line IDs (hashes of its lines that are not blank). Prefix doubling:
a position's rank is the place of its prefix (1 line, then 2, 4 ... up to ``min_lines``, and from there twice as many each time)
in the sorted order of all prefixes of that length; the next rank comes from
sorting the pairs of the rank at the position and the rank at the offset. A
position whose prefix is unique drops out, and doubling ends when none is left.

Positions with equal rank at ``min_lines`` form an interval of suffixes with a common prefix of at least that many lines. All but its
first (by doc_id, then line) begin a later copy. Later copies that follow one another, of first positions that follow one another, are one
run; how long its common prefix with the run it repeats is comes from the ranks of all lengths, the longest first. Such a
prefix of a run is deleted whole. So are later copies of shorter prefixes (1, 2, 4 ... lines) if these lines have ``min_chars`` characters together.

Defined results: a null or empty text has no lines; blank lines (spaces and tabs only) are not looked at and stay;
of repeated rows the later ones count as copies only under another doc_id or row content; runs never cross documents; texts and
runs are as long as they are; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import keyed, materialize, on_key

MIN_LINES = 3
#: Fewer lines than that count as a run if they have so many characters (some 30 words).
MIN_CHARS = 200


def _lines(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "\n")).otherwise(F.array().cast("array<string>"))


def _ranked(positions: DataFrame, a: str, b: str, tag: str) -> DataFrame:
    """The positions whose pair (a, b) is not unique, with its rank in sorted order and its first position."""
    groups = positions.groupBy(a, b).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row_key", "i")).alias("first")).where("n > 1")
    names = materialize(groups.orderBy(a, b).select(a, b, "first", F.monotonically_increasing_id().alias("rank")), f"names-{tag}")
    return materialize(positions.join(names, [a, b]).select("row_key", "doc_id", "i", "line", "chars", "rank", "first"), f"ranked-{tag}")


def _starts(ranked: DataFrame, length: int, least_chars: int = 0) -> DataFrame:
    """The lines of the later copies among positions ranked at ``length``."""
    later = ranked.where((F.col("first") != F.struct("doc_id", "row_key", "i")) & (F.col("chars") >= least_chars))
    return later.select("row_key", "doc_id", F.explode(F.sequence("i", F.col("i") + length - 1)).alias("i"))


def _longer(at: DataFrame, length: int, offset: int) -> DataFrame:
    """Ranks at ``length + offset`` of the positions that are ranked at ``length`` here and at the offset."""
    # characters of the longer prefix, as long as its halves do not overlap; after that nobody asks
    ahead = at.select("row_key", F.col("doc_id").alias("same_doc"), (F.col("i") - offset).alias("i"), F.col("rank").alias("next"), F.col("chars").alias("more"))
    pairs = at.withColumnRenamed("rank", "own").drop("first").join(ahead, ["row_key", "i"]).where(F.col("doc_id").eqNullSafe(F.col("same_doc")))
    return _ranked(pairs.withColumn("chars", F.col("chars") + F.col("more")), "own", "next", str(length + offset))


def ranks(lines: DataFrame, min_lines: int = MIN_LINES) -> list[tuple[int, DataFrame]]:
    """Lengths and ranked positions: up to ``min_lines``, and doubled until every position is unique."""
    levels = [(1, _ranked(lines, "id", "id2", "1"))]
    while True:
        length, at = levels[-1]
        offset = min(length, min_lines - length) if length < min_lines else length
        longer = _longer(at, length, offset)
        if length >= min_lines and longer.isEmpty():
            return levels
        levels.append((length + offset, longer))


def repeated_runs(levels: list[tuple[int, DataFrame]], min_lines: int = MIN_LINES) -> DataFrame:
    """row_key, doc_id, i, n (lines) and of (doc_id, row_key, i of what it repeats) of each run of later copies; n is the longest common prefix."""
    at = next(table for length, table in levels if length == min_lines)
    later = at.where(F.col("first") != F.struct("doc_id", "row_key", "i")).select("row_key", "doc_id", "i", F.col("first").alias("of"))
    by = Window.partitionBy("row_key", "doc_id").orderBy("i")
    was = F.lag(F.struct("i", "of")).over(by)
    goes_on = (was["i"] == F.col("i") - 1) & was["of"]["doc_id"].eqNullSafe(F.col("of.doc_id")) & (was["of"]["row_key"] == F.col("of.row_key")) & (was["of"]["i"] == F.col("of.i") - 1)
    runs = later.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).where("not goes_on").select("row_key", "doc_id", "i", "of", F.lit(0).alias("n"))
    for length, table in reversed(levels):
        here, there = (table.select(F.col("row_key").alias(f"{x}_key"), F.col("doc_id").alias(f"{x}_doc"), F.col("i").alias(f"{x}_i"), F.col("rank").alias(f"{x}_rank")) for x in "ab")
        own = (F.col("row_key") == F.col("a_key")) & (F.col("i") + F.col("n") == F.col("a_i")) & F.col("doc_id").eqNullSafe(F.col("a_doc"))
        other = (F.col("of.row_key") == F.col("b_key")) & (F.col("of.i") + F.col("n") == F.col("b_i")) & F.col("of.doc_id").eqNullSafe(F.col("b_doc"))
        both = runs.join(here, own, "left").join(there, other, "left")
        same = F.coalesce(F.col("a_rank") == F.col("b_rank"), F.lit(False))
        runs = materialize(both.select("row_key", "doc_id", "i", "of", (F.col("n") + F.when(same, length).otherwise(0)).alias("n")), f"runs-{length}")
    return runs


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """row_key, doc_id, i (number of the line among those not blank) and line (its number) of the lines to delete."""
    split = docs.select("row_key", "doc_id", F.posexplode(_lines(F.col("text"))).alias("line", "words")).where(~F.col("words").rlike("^[ \\t\\r]*\\z"))
    order = Window.partitionBy("row_key", "doc_id").orderBy("line")
    numbered = split.select("row_key", "doc_id", "line", F.xxhash64("words").alias("id"), F.xxhash64(F.lit(1), "words").alias("id2"), F.length("words").alias("chars")).distinct()
    lines = materialize(numbered.withColumn("i", F.row_number().over(order) - 1), "lines")
    levels = ranks(lines, min_lines)
    gone = repeated_runs(levels, min_lines).select("row_key", "doc_id", F.explode(F.sequence("i", F.col("i") + F.col("n") - 1)).alias("i"))
    for length, table in levels:
        if length < min_lines:
            gone = gone.unionByName(_starts(table, length, min_chars))
    return gone.distinct().join(lines.select("row_key", "i", "line"), ["row_key", "i"]).select("row_key", "doc_id", "i", "line").distinct()


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_text of each document."""
    docs = keyed(docs, id_col, text_col)
    gone = later_copies(docs, min_lines, min_chars)
    order = Window.partitionBy("row_key", "doc_id").orderBy("line")
    runs = gone.withColumn("new_run", F.coalesce(F.col("i") - F.lag("i").over(order) != 1, F.lit(True)).cast("int")).withColumn("gap", F.col("line") - F.coalesce(F.lag("line").over(order), F.lit(-1)) - 1)
    # For each removed line how many kept ones precede it; together they make a mask of the document.
    listed = runs.groupBy("row_key", "doc_id").agg(F.count("*").alias("n_removed"), F.sum("new_run").alias("n_runs"), F.array_sort(F.collect_list(F.struct("line", "gap"))).alias("gone"))
    both = on_key(docs, listed, "left").withColumn("lines", _lines(F.col("text")))
    mask = F.flatten(F.transform("gone", lambda g: F.concat(F.array_repeat(F.lit(False), g["gap"]), F.array(F.lit(True)))))
    both = both.withColumn("mask", F.coalesce(mask, F.array().cast("array<boolean>")))
    kept = F.array_join(F.filter("lines", lambda _, k: ~F.coalesce(F.get(F.col("mask"), k), F.lit(False))), "\n")
    return both.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"),
        kept.alias("kept_text"),
    )


ORACLE = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE length(text) > 0),
l AS (SELECT doc_id, unnest(w) AS words, unnest(range(len(w))) AS line FROM split),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS i FROM l WHERE NOT regexp_full_match(words, '[ \\t\\r]*')),
win AS (SELECT doc_id, i, o + 1 AS size, list(words) OVER (PARTITION BY doc_id, o ORDER BY i ROWS BETWEEN CURRENT ROW AND o FOLLOWING) AS run,
  sum(length(words)) OVER (PARTITION BY doc_id, o ORDER BY i ROWS BETWEEN CURRENT ROW AND o FOLLOWING) AS chars FROM n, (VALUES (0), (1), ({MIN_LINES - 1})) t(o)),
f AS (SELECT doc_id, i, size, chars, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM win WHERE len(run) = size),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM f, range({MIN_LINES}) t(o) WHERE k > 1 AND o < size AND (size = {MIN_LINES} OR chars >= {MIN_CHARS})),
marked AS (SELECT n.doc_id, n.line, n.i, n.i - lag(n.i) OVER (PARTITION BY n.doc_id ORDER BY n.i) AS step FROM n JOIN gone USING (doc_id, i)),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE step IS NULL OR step <> 1) AS n_runs FROM marked GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(l.words, chr(10) ORDER BY l.line) AS t FROM l ANTI JOIN marked ON l.doc_id = marked.doc_id AND l.line = marked.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(s.w), 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_runs, 0) AS n_runs, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN split s USING (doc_id) LEFT JOIN runs r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
