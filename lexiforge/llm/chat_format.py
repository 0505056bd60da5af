"""Preference formatting of chosen and rejected conversations. DataFrame functions only.

The longest common turn prefix of both conversations is rendered once as the
prompt; what is left of each is rendered as its completion, with the character
ranges that count for the loss: the text and end mark of assistant turns.

Defined results: turns are ordered by turn, role and text, identical rows count
once; a null text is empty, a null role is ``unknown``; rows without conv_id are left out; the template's
marks inside a text are broken up, so that a text cannot fake a turn; a conversation
that is a prefix of the other has an empty completion; a pair lacking one side has
no common prefix, and null for that side; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The turn template.
START, AFTER_ROLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def conversations_as_rows(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and its turns in order."""
    safe = lambda c, if_null: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit(if_null)), "<\\|", "< |")
    role = F.regexp_replace(safe(role_col, "unknown"), "[\\r\\n]+", " ")
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), safe(text_col, "").alias("text"))
    rows = turns.select(F.col(id_col).alias("conv_id"), turn.alias("t")).where("conv_id is not null").distinct()
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """Ranges ``from-to`` (characters of the rendered text) of what is trained on, with commas."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(a, t):
        head = a["at"] + len(START) + F.length(t["role"]) + len(AFTER_ROLE)
        end = head + F.length(t["text"]) + len(END)
        mine = F.when(t["role"] == TRAINED_ROLE, F.array(F.concat(head.cast("string"), F.lit("-"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(a["spans"], mine).alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step, lambda a: a["spans"]), ",")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs``: pair_id, chosen_id, chosen, rejected_id, rejected (turns as of ``conversations_as_rows``)."""
    both = F.least(F.size("chosen"), F.size("rejected"))
    differ = F.zip_with(F.slice("chosen", 1, both), F.slice("rejected", 1, both), lambda x, y: (x["role"] != y["role"]) | (x["text"] != y["text"]))
    first = F.array_position(differ, True).cast("int")
    common = F.when(F.col("chosen").isNull() | F.col("rejected").isNull(), 0).when(first > 0, first - 1).otherwise(both)
    rows = pairs.withColumn("n_prompt_turns", common)
    rest = {side: F.slice(side, F.col("n_prompt_turns") + 1, F.size(side)) for side in ("chosen", "rejected")}
    rows = rows.select("*", *(turns.alias(f"{side}_rest") for side, turns in rest.items()))
    prompt = F.coalesce(_rendered(F.slice(F.coalesce("chosen", "rejected"), 1, F.col("n_prompt_turns"))), F.lit(""))
    return rows.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        prompt.alias("prompt"),
        _rendered(F.col("chosen_rest")).alias("chosen"),
        _mask(F.col("chosen_rest")).alias("chosen_mask"),
        _rendered(F.col("rejected_rest")).alias("rejected"),
        _mask(F.col("rejected_rest")).alias("rejected_mask"),
    )


def neighbours_as_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected)."""
    sided = conversations.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), "conv_id", "turns")
    chosen = sided.where("conv_id % 2 = 0").select("pair_id", F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"))
    rejected = sided.where("conv_id % 2 <> 0").select("pair_id", F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    return chosen.join(rejected, "pair_id", "full")


def _sql_side(side: str) -> str:
    return f"""string_agg('{START}' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) FILTER (WHERE side = '{side}' AND k > common),
  string_agg(CASE WHEN role = '{TRAINED_ROLE}' THEN (before + 13 + length(role))::VARCHAR || '-' || (before + 24 + length(role) + length(text))::VARCHAR END, ',' ORDER BY k) FILTER (WHERE side = '{side}' AND k > common)"""


ORACLE = rf"""
WITH t AS (SELECT DISTINCT conv_id, turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '[\r\n]+', ' ', 'g') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, (conv_id - conv_id % 2) // 2 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'c' ELSE 'r' END AS side FROM t),
ids AS (SELECT pair_id, max(conv_id) FILTER (WHERE side = 'c') AS chosen_id, max(conv_id) FILTER (WHERE side = 'r') AS rejected_id, max(k) FILTER (WHERE side = 'c') AS nc, max(k) FILTER (WHERE side = 'r') AS nr FROM n GROUP BY pair_id),
eq AS (SELECT c.pair_id, min(c.k) AS first FROM n c JOIN n r ON c.pair_id = r.pair_id AND c.k = r.k AND c.side = 'c' AND r.side = 'r' WHERE c.role <> r.role OR c.text <> r.text GROUP BY c.pair_id),
p AS (SELECT ids.*, CASE WHEN nc IS NULL OR nr IS NULL THEN 0 ELSE coalesce(first - 1, least(nc, nr)) END AS common FROM ids LEFT JOIN eq USING (pair_id)),
m AS (SELECT n.*, p.common, chosen_id, rejected_id, coalesce(sum(length(role) + length(text) + 24) OVER (PARTITION BY n.conv_id, k > common ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n JOIN p USING (pair_id)),
o AS (SELECT pair_id, any_value(chosen_id) AS chosen_id, any_value(rejected_id) AS rejected_id, any_value(common) AS common,
  string_agg('{START}' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) FILTER (WHERE side = 'c' AND k <= common) AS prompt,
  {_sql_side("c").replace("),\n", ") AS chosen,\n", 1)} AS chosen_mask,
  {_sql_side("r").replace("),\n", ") AS rejected,\n", 1)} AS rejected_mask
FROM m GROUP BY pair_id)
SELECT pair_id, chosen_id, rejected_id, common::BIGINT AS n_prompt_turns, coalesce(prompt, '') AS prompt,
  CASE WHEN chosen_id IS NOT NULL THEN coalesce(chosen, '') END AS chosen, CASE WHEN chosen_id IS NOT NULL THEN coalesce(chosen_mask, '') END AS chosen_mask,
  CASE WHEN rejected_id IS NOT NULL THEN coalesce(rejected, '') END AS rejected, CASE WHEN rejected_id IS NOT NULL THEN coalesce(rejected_mask, '') END AS rejected_mask
FROM o
"""
