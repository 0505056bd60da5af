"""Sections of build logs, and what to read of them: all logs and all their sections at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an error line has in it, how many of them or of all lines are read, and how many characters.
ERROR, MOST_ERRORS, MOST_LINES, MOST_CHARS = r"(?i)error|fail|exception|traceback|panic|undefined", 15, 50, 3000
_GROUP = r"^##\[group\](.+?)(?:\s|$)"


def log_lines(logs: DataFrame, id_col: str = "log_id", text_col: str = "text") -> DataFrame:
    """log, line (from 0), words, step (what stands before the first tab), group (how many group markers there are up to here), title (a marker's)."""
    rows = logs.select(F.col(id_col).alias("log"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line", "words"))
    step = F.when(F.instr("words", "\t") > 1, F.substring_index("words", "\t", 1))
    title = F.nullif(F.trim(F.regexp_extract("words", _GROUP, 1)), F.lit(""))
    upto = Window.partitionBy("log").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"step": step, "title": F.when(F.col("words").rlike(_GROUP), title)})
    return rows.withColumn("group", F.count_if(F.col("words").rlike(_GROUP)).over(upto).cast("int"))


def step_sections(lines: DataFrame) -> DataFrame:
    """``log_lines`` of the steps, with section (a step's place in the order in which steps begin) and name: from a step's first line up to the next line of another step.

    Lines without a step belong to the step before them; what stands before the first step, and later parts of a step that was
    interrupted, are in no section.
    """
    by = Window.partitionBy("log").orderBy("line")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("name", F.last("step", ignorenulls=True).over(upto)).where("name is not null")
    starts = F.coalesce(F.col("name") != F.lag("name").over(by), F.lit(True))
    rows = rows.withColumn("starts", starts).withColumn("run", F.count_if("starts").over(upto))
    rows = rows.withColumn("first", F.min("run").over(Window.partitionBy("log", "name"))).where("run = first")
    # the runs that are left, numbered without gaps: as many as have begun up to here
    return rows.withColumn("section", F.count_if("starts").over(upto).cast("int")).select("log", "section", "name", "line", "words")


def group_sections(lines: DataFrame) -> DataFrame:
    """``log_lines`` with section (the number of their group marker) and name, the marker's line first; lines before the first marker are in none."""
    name = F.max("title").over(Window.partitionBy("log", "group"))
    return lines.where("group > 0").select("log", F.col("group").alias("section"), name.alias("name"), "line", "words")


def whole_logs(lines: DataFrame) -> DataFrame:
    """Every log as one section 0."""
    return lines.select("log", F.lit(0).alias("section"), F.lit(None).cast("string").alias("name"), "line", "words")


def nested_sections(lines: DataFrame) -> DataFrame:
    """log, step_section, step, group_section, first_line, last_line: the groups that lie inside a step's section, as intervals of lines."""
    steps = step_sections(lines).groupBy("log", F.col("section").alias("step_section"), F.col("name").alias("step")).agg(F.min("line").alias("step_from"), F.max("line").alias("step_to"))
    groups = group_sections(lines).groupBy("log", F.col("section").alias("group_section")).agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"))
    inside = steps.join(groups, "log").where("first_line between step_from and step_to")
    return inside.select("log", "step_section", "step", "group_section", "first_line", F.least("last_line", "step_to").alias("last_line"))


def excerpts(sections: DataFrame, most_errors: int = MOST_ERRORS, most_lines: int = MOST_LINES, most_chars: int = MOST_CHARS) -> DataFrame:
    """log, section, name, errors (how many lines are one), excerpt: the last error lines, or else the last lines, cut to ``most_chars``.

    Only the last lines of each kind come together: two top-k of a section.
    """
    rows = sections.withColumn("bad", F.col("words").rlike(ERROR))
    counts = rows.groupBy("log", "section").agg(F.max("name").alias("name"), F.count_if("bad").alias("errors"))
    last = Window.partitionBy("log", "section").orderBy(F.desc("line"))
    tails = [part.withColumn("back", F.row_number().over(last)).where(F.col("back") <= most).select("log", "section", "bad", "line", "words") for part, most in ((rows.where("bad"), most_errors), (rows.where("not bad"), most_lines))]
    held = tails[0].unionByName(tails[1]).join(counts, ["log", "section"]).where("bad or errors = 0")
    joined = held.groupBy("log", "section", "name", "errors").agg(F.array_sort(F.collect_list(F.struct("line", "words"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["words"]), "\n")
    cut: Column = F.when(F.length(text) > most_chars, F.concat(F.substring(text, 1, most_chars), F.lit("\n… (truncated)"))).otherwise(text)
    return joined.select("log", "section", "name", "errors", cut.alias("excerpt"))
