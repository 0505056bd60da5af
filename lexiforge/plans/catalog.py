"""The library's queries over the test tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.functions import urls as U
from lexiforge.operators import articles, bm25, discovery, html, ranking, research, retrieval, screening, sections, state
from lexiforge.plans import compose
from lexiforge.sources import postings
from lexiforge.sources.work import spread, work_folder

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

QUERY = "the and thanedble attion anea eriner"
NOW = "2024-02-15 00:00:00"


def _register(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found  # tables whose texts are worked on


# SQL that several checks share.
_W = r"[ \t\n\r\f\x0B]"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _sql_terms(text: str) -> str:
    clean = f"lower(coalesce({text}, ''))"
    for pattern, by in ((r"(?s)```.*?```", " "), (r"`[^`]+`", " "), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"!\[([^\]]*)\]\([^)]+\)", " "), (r"<[^>]+>", " "), (r"[^a-z0-9_ \t\n\r\f\x0B-]", " ")):
        clean = f"regexp_replace({clean}, '{pattern}', '{by}', 'g')"
    return f"list_filter(string_split_regex({clean}, '{_W}+'), lambda w: length(w) >= 2 AND w NOT IN ({_STOP}))"


_CHUNKS = f"""
lines AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS chunk FROM documents),
chunks AS (SELECT file, chunk, line, {_sql_terms("line")} AS terms FROM lines WHERE trim(line) <> ''),
corpus AS (SELECT count(*) AS n, avg(len(terms)) AS avg_terms FROM chunks),
post AS (SELECT file, chunk, len(terms) AS len, unnest(terms) AS term FROM chunks),
asked AS (SELECT term, count(*) AS mult FROM (SELECT unnest({_sql_terms(f"'{QUERY}'")}) AS term) GROUP BY term),
found AS (SELECT file, chunk, len, term, mult, count(*) AS tf FROM post JOIN asked USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, count(DISTINCT file) AS file_df FROM found GROUP BY term),
scored AS (SELECT file, chunk, sum(mult * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_terms))) AS score FROM found JOIN df USING (term), corpus GROUP BY file, chunk)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.index(bm25.line_chunks(table(spark, sf_dir, "documents")))


_indexes: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The index of the lines of all documents, built once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        folder = work_folder(spark, "corpus-index")
        postings.write_postings(bm25.line_chunks(table(spark, sf_dir, "documents")), folder)
        _indexes[key] = folder
    return postings.read_postings(spark, _indexes[key])


@_register(f"""WITH {_CHUNKS},
telling AS (SELECT term FROM df WHERE file_df <= greatest(1, floor((SELECT count(DISTINCT file) FROM chunks) * 2 / 3))),
allowed AS (SELECT DISTINCT file, chunk FROM found JOIN telling USING (term)),
r AS (SELECT file, chunk, round(score, 9) AS score FROM scored JOIN allowed USING (file, chunk) WHERE score > 0),
capped AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, chunk) AS k FROM r)
SELECT file, chunk, score, row_number() OVER (ORDER BY score DESC, file, chunk) AS rank FROM capped WHERE k <= 2 ORDER BY score DESC, file, chunk LIMIT 8""")
def corpus_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.range(1).select(F.col("id").alias("query_id"), F.lit(QUERY).alias("text"))
    return retrieval.search(stored_index(spark, sf_dir), one).select("file", "chunk", "score", "rank")


_ITEMS = _CHUNKS.replace(f"asked AS (SELECT term, count(*) AS mult FROM (SELECT unnest({_sql_terms(f"'{QUERY}'")}) AS term) GROUP BY term)", f"asked AS (SELECT item_id, term, count(*) AS mult FROM (SELECT item_id, unnest({_sql_terms('text')}) AS term FROM benchmark) GROUP BY ALL)")
_ITEMS = _ITEMS.replace("found AS (SELECT file, chunk, len, term, mult,", "hit AS (SELECT file, chunk, len, term, count(*) AS tf FROM post WHERE term IN (SELECT term FROM asked) GROUP BY ALL),\nfound AS (SELECT item_id, file, chunk, len, term, mult, tf FROM hit JOIN asked USING (term)),\nnone AS (SELECT file, chunk, len, term, mult,")
_ITEMS = _ITEMS.replace("count(DISTINCT file) AS file_df FROM found", "count(DISTINCT file) AS file_df FROM hit").replace("scored AS (SELECT file, chunk,", "scored AS (SELECT item_id, file, chunk,").replace("corpus GROUP BY file, chunk)", "corpus GROUP BY item_id, file, chunk)")


@_register(f"""WITH {_ITEMS},
telling AS (SELECT term FROM df WHERE file_df <= greatest(1, floor((SELECT count(DISTINCT file) FROM chunks) * 2 / 3))),
allowed AS (SELECT DISTINCT item_id, file, chunk FROM found JOIN telling USING (term)),
r AS (SELECT item_id, file, chunk, round(score, 9) AS score FROM scored JOIN allowed USING (item_id, file, chunk) WHERE score > 0),
capped AS (SELECT *, row_number() OVER (PARTITION BY item_id, file ORDER BY score DESC, chunk) AS k FROM r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, file, chunk) AS rank FROM capped WHERE k <= 2)
SELECT item_id, rank::INTEGER AS rank, file, chunk, round(score, 6) AS score FROM ranked WHERE rank <= 8""")
def corpus_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = retrieval.search(stored_index(spark, sf_dir), items)
    return found.select(F.col("query_id").alias("item_id"), "rank", "file", "chunk", F.round("score", 6).alias("score"))


@_register(f"WITH {_CHUNKS} SELECT file, chunk, round(score, 6) AS score FROM scored")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.scores(corpus(spark, sf_dir), QUERY).withColumn("score", F.round("score", 6))


@_register(f"""WITH {_CHUNKS} SELECT term, count(*) AS n, count(DISTINCT (file, chunk)) AS chunk_df, count(DISTINCT file) AS file_df FROM post GROUP BY term""")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_statistics(corpus(spark, sf_dir))


@_register(rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '{_W}+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS x FROM w),
c AS (SELECT doc_id, length(x) AS n, length(regexp_replace(x, '[{{}}\[\]()<>|&^$#@!%*+=~`\\/:;,"'']', '', 'g')) AS rest FROM u),
t AS (SELECT doc_id, sum(CASE WHEN n - rest > n * 0.4 THEN n WHEN n <= 7 THEN 1 ELSE ceil(n / 4) END) AS tokens, count(*) AS words FROM c GROUP BY doc_id)
SELECT d.doc_id, greatest(1, coalesce(tokens, 0))::BIGINT AS tokens, coalesce(words, 0) AS words, substr(sha256(text), 1, 12) AS short_hash FROM documents d LEFT JOIN t USING (doc_id)""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(t).cast("long").alias("tokens"), T.word_count(t).cast("long").alias("words"), T.short_hash(t).alias("short_hash"))


_URL = r"regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)(?:\?([^#]*))?', ['scheme', 'host', 'path', 'query'])"
_PARTS = f"p AS (SELECT page_id, url, html, x.scheme AS scheme, lower(x.host) AS host, x.path AS path, x.query AS query, regexp_replace(lower(x.host), '^www\\.', '') AS domain FROM (SELECT *, {_URL} AS x FROM pages))"
_DROP = ", ".join(f"'{n}'" for n in U.TRACKING_NAMES)


@_register(f"""WITH {_PARTS},
q AS (SELECT page_id, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ({_DROP})) AS kept FROM p),
o AS (SELECT page_id, unnest(kept) AS x, unnest(range(len(kept))) AS i FROM q),
s AS (SELECT page_id, string_agg(CASE WHEN contains(x, '=') THEN x ELSE x || '=' END, '&' ORDER BY split_part(x, '=', 1), i) AS search FROM o GROUP BY page_id)
SELECT p.page_id, p.host, p.domain, lower(scheme) || '://' || domain || coalesce(nullif(regexp_replace(path, '/+$', ''), ''), '/') || coalesce('?' || replace(search, '%20', '+'), '') AS canonical,
  regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://[^/]+)/$', '\\1') AS queue_key
FROM p LEFT JOIN s USING (page_id)""")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.host(u).alias("host"), U.domain(u).alias("domain"), U.canonical_url(u).alias("canonical"), U.queue_key(u).alias("queue_key"))


@_register(f"""WITH {_PARTS}, d AS (SELECT page_id, lower(scheme) || '://' || domain || coalesce(nullif(regexp_replace(path, '/+$', ''), ''), '/') AS key FROM p)
SELECT key, min(page_id) AS first_page, count(*) AS spellings FROM d GROUP BY key""")
def first_of_each_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.regexp_replace(U.canonical_url(F.regexp_replace("url", "[?#].*$", "")), "$", "")
    return table(spark, sf_dir, "pages").groupBy(key.alias("key")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("spellings"))


_TYPE = """CASE WHEN domain IN ('github.com', 'gitlab.com') THEN 'repo'
  WHEN domain IN ('arxiv.org', 'doi.org') OR contains(lower(url), '/paper/') OR contains(lower(url), '/pdf/') THEN 'academic'
  WHEN regexp_matches(domain, '^(docs|developer|developers|api)\\.') OR regexp_matches(lower(title), 'documentation|docs|reference') OR regexp_matches(lower(url), '/(docs|reference|api)/') THEN 'official-docs'
  WHEN starts_with(domain, 'blog.') OR contains(lower(url), '/blog/') THEN 'maintainer-blog' ELSE 'website' END"""
_TITLE = r"coalesce(nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')), ''), host)".replace('\\"', '"')


@_register(f"""WITH {_PARTS}, t AS (SELECT *, {_TITLE} AS title FROM p), k AS (SELECT page_id, domain, title, {_TYPE} AS source_type FROM t)
SELECT page_id, title, source_type, CASE source_type WHEN 'official-docs' THEN 5 WHEN 'repo' THEN 4 WHEN 'academic' THEN 4 WHEN 'maintainer-blog' THEN 3 ELSE 2 END AS priority,
 CASE WHEN source_type IN ('official-docs', 'academic') THEN 'authoritative' WHEN source_type IN ('repo', 'maintainer-blog') THEN 'credible' ELSE 'mixed' END AS tier FROM k""")
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("title", html.title(F.col("html"), F.col("url")))
    kind = ranking.source_type(U.domain(F.col("url")), F.col("title"), F.col("url"))
    rows = pages.withColumn("source_type", kind)
    return rows.select("page_id", "title", "source_type", ranking.type_priority(F.col("source_type")).alias("priority"), ranking.trust_tier(F.col("source_type")).alias("tier"))


@_register(r"""WITH l AS (SELECT url AS src, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages),
c AS (SELECT src, regexp_replace(trim(href), '#.*$', '') AS h, regexp_extract(src, '^([a-zA-Z]+://[^/?#]+)', 1) AS origin FROM l)
SELECT DISTINCT src, CASE WHEN regexp_matches(h, '(?i)^https?://') THEN h ELSE origin || h END AS dst FROM c WHERE h <> '' AND (regexp_matches(h, '(?i)^https?://') OR starts_with(h, '/'))""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(table(spark, sf_dir, "pages"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lists of four engines for five queries, out of the pages: each engine sees a third of them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.title(F.col("html"), F.col("url")).alias("title"), F.substring("html", 1, 200).alias("snippet"))
    engines = F.explode(F.array(*(F.struct(F.lit(e).alias("engine"), F.lit(ranking.ENGINE_WEIGHTS[e]).alias("weight"), F.lit(k).alias("k")) for k, e in enumerate(("google", "bing", "ddg", "yahoo")))))
    rows = pages.withColumn("e", engines).where((F.col("page_id") + F.col("e.k")) % 3 == 0)
    query = F.concat(F.lit("topic "), (F.col("page_id") % 5).cast("string"))
    return rows.select(query.alias("query"), "e.engine", F.col("page_id").alias("rank"), "url", "title", "snippet", U.host(F.col("url")).alias("domain"), "e.weight")


_HITS = f"""{_PARTS}, t AS (SELECT *, {_TITLE} AS title FROM p),
e(engine, weight, k) AS (VALUES ('google', 10, 0), ('bing', 3, 1), ('ddg', 2, 2), ('yahoo', 1, 3)),
q AS (SELECT page_id, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ({_DROP})) AS kept FROM p),
o AS (SELECT page_id, unnest(kept) AS x, unnest(range(len(kept))) AS i FROM q),
s AS (SELECT page_id, string_agg(x, '&' ORDER BY split_part(x, '=', 1), i) AS search FROM o GROUP BY page_id),
hits AS (SELECT 'topic ' || (t.page_id % 5) AS query, engine, weight, t.page_id, title, host, lower(scheme) || '://' || domain || coalesce(nullif(regexp_replace(path, '/+$', ''), ''), '/') || coalesce('?' || search, '') AS key
  FROM t LEFT JOIN s USING (page_id), e WHERE (t.page_id + k) % 3 = 0)"""


@_register(f"""WITH {_HITS}
SELECT query, key AS url, arg_max(title, (weight, -page_id, engine)) AS title, arg_max(host, (weight, -page_id, engine)) AS domain, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, (sum(weight) + 2 * (count(*) - 1))::BIGINT AS engine_score
FROM hits GROUP BY query, key""")
def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.merge_hits(hits(spark, sf_dir))
    return out.select("query", "url", "title", "domain", F.array_join("engines", ",").alias("engines"), "engine_score")


@_register()
def ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_results(hits(spark, sf_dir), profile="docs-first", limit=25)


@_register(f"""WITH {_HITS}, g AS (SELECT key, sum(1.0 / (page_id + 1)) + 0.5 * (count(DISTINCT query) - 1) AS score, min(page_id + 1) AS best_rank, count(DISTINCT query) AS n_queries, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines FROM hits GROUP BY key)
SELECT key, engines, best_rank, n_queries, floor(score * 1000 + 0.5) / 1000 AS score FROM g""")
def fused_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = hits(spark, sf_dir).withColumn("rank", F.col("rank") + 1)
    return ranking.fuse_ranks(lists).select("key", F.array_join("engines", ",").alias("engines"), "best_rank", "n_queries", "score")


@_register(f"""WITH {_PARTS}, t AS (SELECT *, {_TITLE} AS title FROM p), k AS (SELECT page_id % 7 AS query, domain, {_TYPE} AS source_type, CASE page_id % 11 WHEN 0 THEN 'dead' WHEN 1 THEN 'skipped' ELSE 'ok' END AS reach FROM t),
tier AS (SELECT *, CASE WHEN source_type IN ('official-docs', 'academic') THEN 'authoritative' WHEN source_type IN ('repo', 'maintainer-blog') THEN 'credible' ELSE 'mixed' END AS tier FROM k),
d AS (SELECT query, count(*) AS u, max(c) AS top FROM (SELECT query, domain, count(*) AS c FROM tier GROUP BY ALL) GROUP BY query),
a AS (SELECT query, count(*) AS n, count(*) FILTER (WHERE tier = 'authoritative') AS authoritative, count(*) FILTER (WHERE tier = 'credible') AS credible, count(*) FILTER (WHERE tier = 'mixed') AS mixed, 0::BIGINT AS community, count(DISTINCT source_type) AS types, bool_or(reach <> 'ok') AS blocked FROM tier GROUP BY query)
SELECT query, authoritative, credible, mixed, community, u AS unique_domains, round(top / n, 9) AS top_domain_share,
 concat_ws(',', CASE WHEN n >= 2 AND (top / n > 0.5 OR types = 1) THEN 'low-diversity' END, CASE WHEN blocked THEN 'bot-check' END) AS caveats FROM a JOIN d USING (query)""")
def trust_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("title", html.title(F.col("html"), F.col("url")))
    reach = F.when(F.col("page_id") % 11 == 0, "dead").when(F.col("page_id") % 11 == 1, "skipped").otherwise("ok")
    rows = pages.select((F.col("page_id") % 7).alias("query"), U.domain(F.col("url")).alias("domain"), ranking.source_type(U.domain(F.col("url")), F.col("title"), F.col("url")).alias("source_type"), reach.alias("reachability"))
    return ranking.trust_profile(rows)


def stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the first line of one of the first eight: about, fresh or old, some speaking against it."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id < 8").select(F.col("doc_id").alias("topic"), F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60).alias("query"))
    rows = docs.withColumn("topic", F.col("doc_id") % 8).join(F.broadcast(asked), "topic")  # eight rows
    against = F.when(F.col("doc_id") % 16 < 8, F.concat("text", F.lit(" This was Debunked as a myth; there is no  evidence."))).otherwise(F.col("text"))
    published = F.when(F.col("doc_id") % 3 > 0, F.date_sub(F.to_date(F.lit(NOW)), (F.col("doc_id") * 37 % 4000).cast("int")).cast("timestamp"))
    shaped = rows.select("doc_id", "query", against.alias("text"), (F.col("doc_id") % 5 == 0).alias("primary"), published.alias("published"))
    return research.stance(shaped, F.to_timestamp(F.lit(NOW)))


_STANCE = rf"""asked AS (SELECT doc_id AS topic, substr(split_part(text, chr(10), 1), 1, 60) AS query FROM documents WHERE doc_id < 8),
r AS (SELECT d.doc_id, query, CASE WHEN d.doc_id % 16 < 8 THEN text || ' This was Debunked as a myth; there is no  evidence.' ELSE text END AS text, d.doc_id % 5 = 0 AS pri,
 CASE WHEN d.doc_id % 3 > 0 THEN (d.doc_id * 37 % 4000) END AS age FROM documents d JOIN asked ON d.doc_id % 8 = topic),
o AS (SELECT *, {_sql_terms("query")} AS qt, ' ' || regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g') || ' ' AS low, len(regexp_extract_all(lower(text), '{research.MARKER_PATTERN}')) AS marks FROM r),
m AS (SELECT doc_id, query, pri, marks, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_filter(qt, lambda t: contains(low, ' ' || replace(t, '-', ' ') || ' '))) / len(qt) END AS overlap,
 CASE WHEN age IS NULL THEN 0.5::DOUBLE WHEN age <= 365 THEN 1 WHEN age <= 1095 THEN 0.7 WHEN age <= 2555 THEN 0.4 ELSE 0.2 END AS fresh FROM o),
l AS (SELECT *, CASE WHEN overlap < 0.15 THEN 'neutral' WHEN marks > 0 THEN 'conflicting' WHEN overlap >= 0.3 THEN 'supporting' ELSE 'neutral' END AS label, (overlap * 0.6::DOUBLE + fresh * 0.4::DOUBLE) * (CASE WHEN pri THEN 1.3::DOUBLE ELSE 1 END) AS mag FROM m),
st AS (SELECT doc_id, query, label, floor(overlap * 1000 + 0.5) / 1000 AS keyword_overlap, marks AS conflict_markers,
 CASE label WHEN 'supporting' THEN floor(mag * 1000 + 0.5) / 1000 WHEN 'conflicting' THEN -floor(mag * (0.5::DOUBLE + least(1, marks * 0.15::DOUBLE)) * 1000 + 0.5) / 1000 ELSE 0 END AS strength FROM l)"""


@_register(f"WITH {_STANCE} SELECT doc_id, label, keyword_overlap, conflict_markers, strength FROM st")
def source_stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stances(spark, sf_dir).select("doc_id", "label", "keyword_overlap", "conflict_markers", "strength")


@_register(f"""WITH {_STANCE}, v AS (SELECT query, count(*) FILTER (WHERE label = 'supporting') AS supporting, count(*) FILTER (WHERE label = 'conflicting') AS conflicting, count(*) FILTER (WHERE label = 'neutral') AS neutral FROM st GROUP BY query)
SELECT query, supporting, conflicting, neutral, CASE WHEN supporting + conflicting = 0 THEN 'insufficient_evidence' ELSE 'other' END AS class FROM v""")
def stance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research.verdicts(stances(spark, sf_dir))
    return out.select("query", "supporting", "conflicting", "neutral", F.when(F.col("verdict") == "insufficient_evidence", "insufficient_evidence").otherwise("other").alias("class"))


@_register(f"""WITH {_STANCE}, v AS (SELECT query, count(*) FILTER (WHERE label = 'supporting') AS supporting, count(*) FILTER (WHERE label = 'conflicting') AS conflicting, count(*) FILTER (WHERE label = 'neutral') AS neutral,
 floor(sum(greatest(strength, 0)) * 1000 + 0.5) / 1000 AS support_score, floor(-sum(least(strength, 0)) * 1000 + 0.5) / 1000 AS conflict_score FROM st GROUP BY query)
SELECT *, CASE WHEN supporting = 0 AND conflicting = 0 THEN 'insufficient_evidence'
 WHEN conflicting = 0 THEN CASE WHEN support_score >= {research.STRONG_SCORE} AND supporting >= {research.STRONG_COUNT} THEN 'supported' ELSE 'likely_supported' END
 WHEN supporting = 0 THEN CASE WHEN conflict_score >= {research.STRONG_SCORE} AND conflicting >= {research.STRONG_COUNT} THEN 'likely_false' ELSE 'contested' END
 WHEN support_score > conflict_score * {research.DOMINANCE} THEN 'likely_supported' WHEN conflict_score > support_score * {research.DOMINANCE} THEN 'likely_false' ELSE 'contested' END AS verdict FROM v""")
def stance_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.verdicts(stances(spark, sf_dir))


def _sql_list(cases: list[tuple[str, str]]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in cases) + ")"


@_register("SELECT doc_id, " + _sql_list([(n, "regexp_matches(text, '" + p.replace("'", "''") + "')") for n, p in screening.SECRETS]) + " AS secrets FROM documents")
def secrets_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(screening.secret_types(F.col("text")), ",").alias("secrets"))


_INJECT = "CASE " + " ".join("WHEN regexp_matches(t, '(?i)" + "|".join(f"(?:{p})" for p in ps).replace("'", "''") + f"') THEN '{n}/{s}'" for n, s, ps in screening.INJECTIONS) + " END"


@_register(f"WITH t AS (SELECT doc_id, substr(text, 1, 3000) AS t FROM documents) SELECT doc_id, {_INJECT} AS injection FROM t")
def injections_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = screening.injection(F.col("text"))
    found = table(spark, sf_dir, "documents").select("doc_id", i.alias("i"))
    return found.select("doc_id", F.when(F.col("i").isNotNull(), F.concat_ws("/", "i.name", "i.severity")).alias("injection"))


@_register()
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", screening.redact(F.col("text")).alias("redacted"))
    return rows.select("doc_id", (F.col("text") != F.col("redacted")).alias("changed"), F.sha2("redacted", 256).alias("redacted_sha256"))


@_register("""WITH m AS (SELECT page_id, len(list_filter([""" + ", ".join("'" + m.replace("'", "''") + "'" for m in screening.BOT_MARKERS) + """], lambda m: contains(lower(substr(html, 1, 8000)), m))) AS n FROM pages),
s AS (SELECT page_id, n, CASE page_id % 4 WHEN 0 THEN 403 ELSE 200 END AS status FROM m)
SELECT page_id, CASE WHEN n >= 2 OR (n >= 1 AND status >= 400) THEN 'generic' END AS wall, CASE WHEN n >= 2 OR (n >= 1 AND status >= 400) THEN least(0.5 + n * 0.15, 0.85) END::DOUBLE AS confidence FROM s""")
def bot_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("page_id") % 4 == 0, 403).otherwise(200)
    w = screening.bot_wall(F.col("html"), status)
    return table(spark, sf_dir, "pages").select("page_id", w["type"].alias("wall"), w["confidence"].alias("confidence"))


_SCAN = f"CASE WHEN length(text) > {screening.WHOLE_FROM} THEN lower(text) ELSE substr(lower(text), 1, {screening.HEAD}) || chr(10) || right(lower(text), {screening.TAIL}) END"


@_register(f"WITH s AS (SELECT doc_id, {_SCAN} AS low FROM documents) SELECT doc_id, (" + " + ".join(f"CASE WHEN contains(low, '{t.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END" for t, _ in screening.PAYWALL_MARKERS) + " + " + " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END" for t, _, _ in screening.PAYWALL_VENDORS) + ")::BIGINT AS markers FROM s JOIN documents USING (doc_id)")
def paywall_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = screening.paywall(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(p["markers"]).cast("long").alias("markers"))


@_register()
def paywalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the detector says, of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", screening.paywall(F.col("text")).alias("p")).select("doc_id", "p.*")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a page: a conversation's turns, each stored twice in a row."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", F.explode(F.array((F.col("turn") * 2), (F.col("turn") * 2 + 1))).alias("at"), "text")


@_register("""WITH s AS (SELECT conv_id, turn * 2 + o AS at, text, turn FROM conversations, range(2) t(o))
SELECT a.conv_id, a.at, sha256(a.text) AS content_hash, sha256(b.text) AS previous_hash FROM s a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""")
def content_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.versions(stores(spark, sf_dir), "conv_id", "at", "text").select("conv_id", "at", "content_hash", "previous_hash")


@_register("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@_register("""SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts AND p.ts = (SELECT max(q.ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND q.ts <= e.ts)) AS purchase FROM events e WHERE e.event_type = 'error'""")
def last_good_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    good = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase"))
    return state.as_of(events.where("event_type = 'error'").select("event_id", "user_id", "ts"), good, "user_id", "ts", "purchase").select("event_id", "purchase")


@_register("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 500")
def newest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.evict_oldest(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", 500, "event_id")


@_register("""WITH s AS (SELECT event_id, sum(1 + event_id % 97) OVER (ORDER BY ts::DATE DESC, ts DESC, event_id) AS upto FROM events) SELECT event_id FROM s WHERE upto <= 100000""")
def within_size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", (1 + F.col("event_id") % 97).alias("bytes"))
    return state.evict_by_size(rows, "ts", "bytes", 100_000, "event_id").select("event_id")


def engine_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of eight engines, out of the events."""
    reason = F.when(F.col("event_id") % 2 == 0, "connection").otherwise("blocked")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).cast("string").alias("engine"), F.date_trunc("second", "ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), F.floor("value").cast("long").alias("latency"), reason.alias("reason")
    )


_LOG = """log AS (SELECT (user_id % 8)::VARCHAR AS engine, date_trunc('second', ts) AS happened, event_id AS seq, event_type <> 'error' AS ok, floor(value)::BIGINT AS latency, CASE WHEN event_id % 2 = 0 THEN 'connection' ELSE 'blocked' END AS reason FROM events),
g AS (SELECT engine, max(row(happened, seq)) AS last_ok FROM log WHERE ok GROUP BY engine),
tail AS (SELECT engine, count(*) AS c, max(row(happened, seq, reason)) AS last FROM log LEFT JOIN g USING (engine) WHERE NOT ok AND (last_ok IS NULL OR row(happened, seq) > last_ok) GROUP BY engine),
tot AS (SELECT engine, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS failures, sum(latency)::BIGINT AS latency_sum, count(*) AS n FROM log GROUP BY engine)"""


@_register(f"""WITH {_LOG} SELECT engine, successes, failures, coalesce(c, 0) AS consecutive, round(successes / n - least(latency_sum / n / 10000, 0.1), 9) AS reliability FROM tot LEFT JOIN tail USING (engine)""")
def engine_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.reliability(state.engine_health(engine_log(spark, sf_dir))).select("engine", "successes", "failures", "consecutive", "reliability")


@_register("""WITH o AS (SELECT user_id AS path, event_id, CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'next' WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS op FROM events),
l AS (SELECT path, arg_max(op, event_id) FILTER (WHERE op <> 'add') AS op, count(*) FILTER (WHERE op = 'fail') AS r FROM o GROUP BY path),
s AS (SELECT CASE WHEN op = 'complete' THEN 'completed' WHEN op = 'fail' AND r >= 3 THEN 'failed' WHEN op = 'next' THEN 'in_progress' ELSE 'queued' END AS status FROM l)
SELECT count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'in_progress') AS in_progress, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total FROM s""")
def queue_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "click", "next").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("add")
    ops = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("user_id").alias("url"), F.col("event_id").alias("seq"), op.alias("op"))
    return state.queue_stats(state.queue_state(ops))


@_register("""WITH RECURSIVE c AS (SELECT user_id % 8 AS host, epoch_us(ts) // 1000000 // 600 AS second, count(*) AS asked FROM events GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY second) AS k FROM c),
r AS (SELECT host, k, second, asked, least(2, asked) AS passed, 2 - least(2, asked) AS left_over FROM s WHERE k = 1
 UNION ALL SELECT s.host, s.k, s.second, s.asked, least(s.asked, least(2, left_over + s.second - r.second)), least(2, left_over + s.second - r.second) - least(s.asked, least(2, left_over + s.second - r.second)) FROM r JOIN s ON s.host = r.host AND s.k = r.k + 1)
SELECT host, second, asked, passed FROM r""")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("host"), F.floor(F.unix_timestamp("ts") / 600).alias("second"))
    return state.token_bucket(rows, burst=2, per_second=1)


@_register("""WITH r AS (SELECT user_id % 6 AS category, event_type <> 'error' AS ok, event_type IN ('purchase', 'signup') AS hit, floor(value)::BIGINT AS tokens, event_id % 5000 AS ms FROM events)
SELECT category, count(*) AS n, round(avg(ok::INT), 9) AS success_rate, round(avg(hit::INT), 9) AS hit_rate, list_sort(list(tokens))[floor(count(*) * 0.5)::INT + 1] AS median_tokens, list_sort(list(ms))[floor(count(*) * 0.5)::INT + 1] AS p50, list_sort(list(ms))[floor(count(*) * 0.95)::INT + 1] AS p95 FROM r GROUP BY category""")
def fetch_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 6).alias("category"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").isin("purchase", "signup").alias("hit"), F.floor("value").cast("long").alias("tokens"), (F.col("event_id") % 5000).alias("ms")
    )
    return state.scorecard(rows, "category")


@_register("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS w, unnest(range(len(string_split(text, chr(10))))) AS chunk FROM documents),
t AS (SELECT doc_id, chunk, len(list_filter(string_split(w, ' '), lambda x: x <> '')) AS tokens FROM l),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY chunk) AS upto FROM t)
SELECT doc_id, count(*) AS chunks, sum(tokens)::BIGINT AS tokens FROM r WHERE upto <= 120 OR chunk = 0 GROUP BY doc_id""")
def budgeted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk", "w"))
    counted = lines.select("doc_id", "chunk", F.size(F.filter(F.split("w", " "), lambda x: x != "")).alias("tokens"))
    return sections.within_budget(counted, 120, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap for each host, out of the pages; most entries are dated."""
    date = F.date_format(F.date_add(F.to_date(F.lit("2023-01-01")), (F.col("page_id") * 7 % 400).cast("int")), "yyyy-MM-dd")
    stamp = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("<lastmod>"), date, F.lit("</lastmod>"))).otherwise("")
    entry = F.concat(F.lit("<url><loc>"), F.regexp_replace("url", "&", "&amp;"), F.lit("</loc>"), stamp, F.lit("</url>"))
    rows = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("site"), F.struct("page_id", entry.alias("e")).alias("e"))
    xml = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["e"]), "\n")
    return rows.groupBy("site").agg(F.concat(F.lit("<urlset>"), xml, F.lit("</urlset>")).alias("xml"))


@_register(f"""WITH {_PARTS}, d AS (SELECT host AS site, url AS loc, page_id, CASE WHEN page_id % 3 > 0 THEN DATE '2023-01-01' + (page_id * 7 % 400)::INT ELSE try_cast(nullif(regexp_extract(url, '/((?:19|20)\\d{{2}})/(\\d{{1,2}})(?:/|$)', 1), '') || '-01-01' AS DATE) END AS date FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS ord, count(date) OVER (PARTITION BY site) * 2 > count(*) OVER (PARTITION BY site) AS by_date FROM d)
SELECT site, loc, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN by_date THEN date END DESC NULLS LAST, ord) AS position FROM o""")
def recency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = discovery.sitemap_entries(sitemaps(spark, sf_dir))
    return discovery.rank_by_recency(entries, ["site"]).select("site", "loc", "position")


@_register(r"""SELECT vec_id, regexp_matches(ip, '^(10|127|0)\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^169\.254\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^192\.0\.(0|2)\.|^192\.88\.99\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(22[4-9]|2[3-5][0-9])\.') AND ip NOT IN ('192.0.0.9', '192.0.0.10') AS private
FROM (SELECT vec_id, (vec_id * 7 % 256)::VARCHAR || '.' || (vec_id * 13 % 256)::VARCHAR || '.' || (vec_id % 256)::VARCHAR || '.9' AS ip FROM embeddings)""")
def private_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: (F.col("vec_id") * k % 256).cast("string")
    ip = F.concat_ws(".", part(7), part(13), part(1), F.lit("9"))
    return table(spark, sf_dir, "embeddings").select("vec_id", U.is_private_ipv4(ip).alias("private"))


@_register("""SELECT lang, source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)""")
def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@_register("""SELECT doc_id, CASE WHEN quality = 1 THEN 'ok' WHEN doc_id % 2 = 0 THEN 'skipped' ELSE 'dead' END AS reachability FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, 'unknown' FROM documents ANTI JOIN labels USING (doc_id)""")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"))
    status = F.when(F.col("doc_id") % 2 == 0, 403).otherwise(404)
    fetched = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("url"), (F.col("quality") == 1).alias("ok"), status.alias("status"), F.lit(None).cast("string").alias("code"))
    return research.citation_audit(ranked, fetched).select(F.col("url").alias("doc_id"), "reachability")


@_register()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.chunk_documents(table(spark, sf_dir, "documents"), 128, 10)


@_register()
def article_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.extract(table(spark, sf_dir, "pages")).select("page_id", "title", "markdown")


@_register()
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = articles.extract(table(spark, sf_dir, "pages"))
    return sections.outline(sections.sections(pages, "page_id", "markdown")).drop("body")


@_register()
def multi_source_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.answer(articles.extract(table(spark, sf_dir, "pages")).withColumnRenamed("markdown", "text"), QUERY)


@_register(r"""WITH p AS (SELECT page_id, CASE WHEN length(html) > 5000 THEN 5016 ELSE length(html) END AS n FROM pages),
l AS (SELECT list({'page_id': page_id, 'n': n, 'room': 200000 - n, 'used': n} ORDER BY page_id) AS ps FROM p),
-- the rule page by page: with 200 left or fewer nothing more, else the page or what is left and the mark
f AS (SELECT list_transform(range(1, len(ps) + 1), lambda k: list_reduce(ps[1:k], lambda a, x: {'page_id': x.page_id, 'n': x.n, 'room': CASE WHEN a.room <= 200 THEN a.room WHEN x.n > a.room THEN -16 ELSE a.room - x.n END, 'used': CASE WHEN a.room <= 200 THEN 0 WHEN x.n > a.room THEN a.room + 16 ELSE x.n END})) AS out FROM l),
u AS (SELECT unnest(out) AS o FROM f)
SELECT o.page_id AS page_id, o.used::BIGINT AS used FROM u WHERE o.used > 0""")
def context_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return compose.context_package(pages, "page_id", 200_000, 5000).select("page_id", F.col("n_chars").alias("used"))


@_register(f"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repo, regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) || CASE WHEN page_id % 4 = 0 THEN '/' WHEN page_id % 7 = 0 THEN '/dist/x.js' WHEN page_id % 7 = 1 THEN '/a.PNG' ELSE '' END AS path FROM pages)
SELECT repo, count(*) FILTER (WHERE NOT ends_with(path, '/')) AS files, count(*) FILTER (WHERE ends_with(path, '/')) AS folders FROM p
WHERE NOT regexp_matches(lower(path), '{"|".join(x.lower().replace(".", "[.]") for x in discovery.EXCLUDED_PATHS)}') GROUP BY repo""")
def repository_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as repositories, with folders, a build and a picture among their paths."""
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    end = F.when(F.col("page_id") % 4 == 0, "/").when(F.col("page_id") % 7 == 0, "/dist/x.js").when(F.col("page_id") % 7 == 1, "/a.PNG").otherwise("")
    return discovery.repository_census(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("repo"), F.concat(path, end).alias("path")))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
