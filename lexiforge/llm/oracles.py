"""DuckDB SQL for the queries of this subpackage that SQL can express on whole small tables."""

from __future__ import annotations

from lexiforge.llm import quality

_SPLIT = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 13], ' ') AS key FROM p),
f AS (SELECT key, min(doc_id) AS lo FROM k GROUP BY key),
g AS (SELECT DISTINCT doc_id, i + o AS i FROM k JOIN f USING (key), range(13) t(o) WHERE doc_id > lo),
gl AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM g),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE was IS NULL OR was <> i - 1) AS n_spans FROM gl GROUP BY doc_id),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
t AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, 1))) AS k FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k + 1 : k + 5], ' ') AS shingle FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id, d.doc_id <= coalesce(y, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""


def _quality() -> str:
    top, dup = list(quality.TOP_NGRAM_PERCENT), list(quality.DUPLICATE_NGRAM_PERCENT)
    parts = []
    for k in sorted({*top, 3, *dup}):
        parts.append(f"g{k} AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + {k}], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(len(ws) - {k - 1})) AS i FROM w WHERE len(ws) >= {k}))")
    for k in top:
        parts.append(
            f"c{k} AS (SELECT doc_id, key, count(*) AS c, count(*) * length(replace(key, ' ', '')) AS chars FROM g{k} GROUP BY doc_id, key HAVING count(*) > 1), "
            f"t{k} AS (SELECT doc_id, arg_max(chars, c * 1000000000 + chars)::BIGINT AS v FROM c{k} GROUP BY doc_id)"
        )
    parts.append("r3 AS (SELECT doc_id, i FROM g3 QUALIFY count(*) OVER (PARTITION BY doc_id, key) > 1), n3 AS (SELECT doc_id, count(DISTINCT i + o) AS v FROM r3, range(3) t(o) GROUP BY doc_id)")
    for k in dup:
        parts.append(
            f"r{k} AS (SELECT doc_id, i FROM g{k} QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY i) > 1), "
            f"d{k} AS (SELECT doc_id, sum(length(word))::BIGINT AS v FROM u JOIN (SELECT DISTINCT doc_id, i + o AS i FROM r{k}, range({k}) t(o)) USING (doc_id, i) GROUP BY doc_id)"
        )
    tables = [f"t{k}" for k in top] + ["n3"] + [f"d{k}" for k in dup]
    values = {**{f"t{k}": f"top_{k}_chars" for k in top}, "n3": "n_repeat_words", **{f"d{k}": f"dup_{k}_chars" for k in dup}}
    chosen = ", ".join(f"coalesce({t}.v, 0) AS {values[t]}" for t in tables)
    joins = " ".join(f"LEFT JOIN {t} ON {t}.doc_id = w.doc_id" for t in tables)
    ok = " AND ".join(
        [f"top_{k}_chars * 100 <= word_chars * {p}" for k, p in quality.TOP_NGRAM_PERCENT.items()]
        + [f"dup_{k}_chars * 100 <= word_chars * {p}" for k, p in quality.DUPLICATE_NGRAM_PERCENT.items()]
        + [
            f"(n_dup_lines < {quality.LEAST_DUPLICATE_LINES} OR n_dup_lines * 100 <= n_lines * {quality.DUPLICATE_LINE_PERCENT})",
            f"dup_line_chars * 100 <= word_chars * {quality.DUPLICATE_LINE_CHARS_PERCENT}",
        ]
    )
    return rf"""
WITH w AS (SELECT doc_id, text, {_SPLIT.format("coalesce(text, '')")} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
uc AS (SELECT doc_id, sum(length(word))::BIGINT AS v FROM u GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM w),
lw AS (SELECT doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lc AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE nth > 1) AS n_dup, coalesce(sum(chars) FILTER (WHERE nth > 1), 0)::BIGINT AS dup_chars FROM lw GROUP BY doc_id),
{", ".join(parts)},
a AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(uc.v, 0) AS word_chars, coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
 coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(dup_chars, 0) AS dup_line_chars, {chosen}
 FROM w LEFT JOIN uc ON uc.doc_id = w.doc_id LEFT JOIN lc ON lc.doc_id = w.doc_id {joins}),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR n_repeat_words * 100 > n_words * {quality.REPEAT_WORDS_PERCENT} AS base_failed FROM a)
SELECT *, NOT base_failed AND {ok} AS kept FROM b
"""


QUALITY = _quality()
