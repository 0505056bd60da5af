"""Queries over what a crawler remembers, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import urls
from lexiforge.operators import state, store

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _register(sql: str):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        _sql[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.to_timestamp("ts"))


# A fold over each domain's events, as the rule says it.
_AGAIN = "(x.at - a.at > INTERVAL 7 DAY)"
_CHEAPER = "(x.ok AND x.rung < a.best)"


@_register(f"""WITH e AS (SELECT (user_id % 40) || '-' || (event_id % 25) AS domain, ts AS t, event_id AS seq, (event_id % 3)::INT AS rung, event_type <> 'error' AS ok FROM events),
l AS (SELECT domain, list({{'at': t, 'rung': rung, 'ok': ok, 'best': CASE WHEN ok THEN rung ELSE 0 END, 'n': ok::INT, 'probe': false, 'f0': (NOT ok AND rung = 0)::INT, 'f1': (NOT ok AND rung = 1)::INT, 'f2': (NOT ok AND rung = 2)::INT}} ORDER BY t, seq) AS es FROM e GROUP BY domain),
r AS (SELECT domain, list_reduce(es, lambda a, x: CASE WHEN {_AGAIN} OR {_CHEAPER} THEN x ELSE
 {{'at': x.at, 'rung': x.rung, 'ok': x.ok, 'best': a.best, 'n': CASE WHEN x.ok THEN (a.n + 1) % 10 ELSE a.n END, 'probe': CASE WHEN x.ok THEN a.n + 1 >= 10 ELSE a.probe END,
  'f0': CASE WHEN x.rung <> 0 THEN a.f0 WHEN x.ok THEN 0 ELSE a.f0 + 1 END, 'f1': CASE WHEN x.rung <> 1 THEN a.f1 WHEN x.ok THEN 0 ELSE a.f1 + 1 END, 'f2': CASE WHEN x.rung <> 2 THEN a.f2 WHEN x.ok THEN 0 ELSE a.f2 + 1 END}} END) AS s FROM l)
SELECT domain, s.best AS rung, s.n AS successes, s.probe AS probe, concat_ws(',', CASE WHEN s.f0 > 0 THEN '0:' || s.f0 END, CASE WHEN s.f1 > 0 THEN '1:' || s.f1 END, CASE WHEN s.f2 > 0 THEN '2:' || s.f2 END) AS failures, epoch_us(s.at) AS updated_us FROM r""")
def strategy_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand domains with outcomes up to weeks apart."""
    domain = F.concat_ws("-", (F.col("user_id") % 40).cast("string"), (F.col("event_id") % 25).cast("string"))
    log = _events(spark, sf_dir).select(domain.alias("domain"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).cast("int").alias("rung"), (F.col("event_type") != "error").alias("ok"))
    return state.strategy_memory(log).withColumn("updated_us", F.unix_micros("updated")).drop("updated")


@_register("""WITH o AS (SELECT (user_id % 20)::VARCHAR AS service, ts AS t, event_id AS seq, event_type = 'error' AS limited, CASE WHEN event_id % 3 > 0 THEN floor(value * 60)::BIGINT END AS seconds FROM events),
l AS (SELECT r.service, r.seq, arg_max(l.t + to_seconds(coalesce(l.seconds, 600)), (l.t, l.seq)) AS until, any_value(r.t) AS t FROM o r LEFT JOIN o l ON l.service = r.service AND l.limited AND (l.t, l.seq) < (r.t, r.seq) WHERE NOT r.limited GROUP BY r.service, r.seq)
SELECT service, seq, until IS NULL OR t >= until AS passed FROM l""")
def latched_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "limited").otherwise("request")
    ops = _events(spark, sf_dir).select((F.col("user_id") % 20).cast("string").alias("service"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), op.alias("op"), F.when(F.col("event_id") % 3 > 0, F.floor(F.col("value") * 60)).alias("seconds"))
    return state.latched(ops).drop("at")


@_register("""WITH o AS (SELECT (user_id % 50)::VARCHAR AS name, ts AS t, event_id AS seq, CASE event_type WHEN 'view' THEN 'put' WHEN 'error' THEN 'drop' ELSE 'get' END AS op, props AS value FROM events),
l AS (SELECT g.name, g.seq, any_value(g.t) AS t, arg_max({'op': p.op, 'at': p.t, 'value': p.value}, (p.t, p.seq)) AS p FROM o g LEFT JOIN o p ON p.name = g.name AND p.op <> 'get' AND (p.t, p.seq) < (g.t, g.seq) WHERE g.op = 'get' GROUP BY g.name, g.seq),
h AS (SELECT name, seq, coalesce(p.op = 'put' AND t - p.at <= INTERVAL 4 HOUR, false) AS hit, p.value AS value FROM l)
SELECT name, seq, hit, CASE WHEN hit THEN value END AS value FROM h""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "view", "put").when(F.col("event_type") == "error", "drop").otherwise("get")
    ops = _events(spark, sf_dir).select((F.col("user_id") % 50).cast("string").alias("name"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), op.alias("op"), F.col("props").alias("value"))
    return state.cache_answers(ops, 4 * 3600).drop("at")


NOW_S = 1_706_650_000


@_register(f"""WITH e AS (SELECT event_id AS path, epoch_us(ts) // 1000000 AS modified, 1000 + event_id % 977 AS bytes, CASE WHEN event_id % 501 = 0 THEN 30000 ELSE 1 END AS files FROM events),
s AS (SELECT *, CASE WHEN files > 20000 THEN greatest(bytes, 1500001) ELSE bytes END AS size, CASE WHEN {NOW_S} - modified < 300 THEN 'active' WHEN {NOW_S} - modified > 604800 THEN 'expired' END AS first FROM e),
t AS (SELECT path, sum(size) OVER (ORDER BY modified DESC, path DESC ROWS UNBOUNDED PRECEDING) AS upto FROM s WHERE first IS NULL)
SELECT s.path, coalesce(first, CASE WHEN upto > 1500000 THEN 'capped' ELSE 'kept' END) AS outcome FROM s LEFT JOIN t USING (path)""")
def swept_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of entries, of which a week and so many bytes may stay; some have too many files to count."""
    events = _events(spark, sf_dir)
    entries = events.select(F.col("event_id").alias("path"), F.unix_seconds("ts").alias("modified"), (1000 + F.col("event_id") % 977).alias("bytes"), F.when(F.col("event_id") % 501 == 0, 30_000).otherwise(1).alias("files"))
    return store.swept(entries, F.lit(NOW_S), 1_500_000).select("path", "outcome")


@_register("""WITH v AS (SELECT user_id % 97 AS url, event_id AS at, event_type AS content, lag(event_type) OVER (PARTITION BY user_id % 97 ORDER BY event_id) AS previous, row_number() OVER (PARTITION BY user_id % 97 ORDER BY event_id DESC) AS back FROM events),
n AS (SELECT * FROM v WHERE back = 1), a AS (SELECT unnest(range(120)) AS url)
SELECT a.url::VARCHAR AS url, n.url IS NOT NULL AS found, n.content, length(n.content)::INTEGER AS length, substr(sha256(n.content), 1, 12) AS hash, n.content = n.previous AS unchanged FROM a LEFT JOIN n ON n.url = a.url""")
def stored_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of many versions of pages, and pages without one."""
    versions = _events(spark, sf_dir).select((F.col("user_id") % 97).cast("string").alias("url"), F.col("event_id").alias("at"), F.lit(None).cast("string").alias("title"), F.col("event_type").alias("content"))
    asked = spark.range(120).select(F.col("id").cast("string").alias("url"))
    return store.content_for(asked, versions).select("url", "found", "content", "length", "hash", "unchanged")


_OCTETS = "[('0x' || substr(md5(url), k, 2))::INT FOR k IN [1, 3, 5, 7]]"


@_register(f"""WITH o AS (SELECT page_id, {_OCTETS} AS o FROM pages),
i AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 10 WHEN 1 THEN 192 WHEN 2 THEN 172 WHEN 3 THEN 169 ELSE 1 + o[1] % 223 END AS a, CASE page_id % 6 WHEN 1 THEN 168 WHEN 2 THEN o[2] % 64 WHEN 3 THEN 254 ELSE o[2] END AS b, CASE page_id % 12 WHEN 3 THEN 169 ELSE o[3] END AS c, CASE page_id % 12 WHEN 3 THEN 254 ELSE o[4] END AS d,
 CASE page_id % 4 WHEN 0 THEN 443 WHEN 1 THEN 22 WHEN 2 THEN 5432 END AS port FROM o),
n AS (SELECT *, a || '.' || b || '.' || c || '.' || d AS ip, a = 10 OR a = 0 OR a = 127 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 88 AND c = 99) OR (a = 192 AND b = 168)
 OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224 AS private FROM i),
r AS (SELECT page_id, CASE page_id % 5 WHEN 4 THEN '::ffff:' || ip ELSE ip END AS ip, CASE WHEN ip = '169.254.169.254' THEN 'cloud-metadata' WHEN NOT private THEN 'public' WHEN a = 10 AND b < 128 OR a = 192 AND b = 168 AND c < 64 THEN 'allowed' ELSE 'private-range' END AS first, port FROM n)
SELECT page_id, ip, CASE WHEN first = 'public' AND port IN (22, 5432) THEN 'dangerous-port' ELSE first END AS decision FROM r""")
def address_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address out of each page's hash, private or public, some as IPv6, with two ranges that are allowed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    a, b, c, d = (F.conv(F.substring(F.md5("url"), k, 2), 16, 10).cast("int") for k in (1, 3, 5, 7))
    n, metadata = F.col("page_id") % 6, F.col("page_id") % 12 == 3
    a, b = F.when(n == 0, 10).when(n == 1, 192).when(n == 2, 172).when(n == 3, 169).otherwise(1 + a % 223), F.when(n == 1, 168).when(n == 2, b % 64).when(n == 3, 254).otherwise(b)
    four = F.concat_ws(".", *(x.cast("string") for x in (a, b, F.when(metadata, 169).otherwise(c), F.when(metadata, 254).otherwise(d))))
    ip = F.when(F.col("page_id") % 5 == 4, F.concat(F.lit("::ffff:"), four)).otherwise(four)
    port = F.when(F.col("page_id") % 4 == 0, 443).when(F.col("page_id") % 4 == 1, 22).when(F.col("page_id") % 4 == 2, 5432)
    policy = urls.address_policy(F.col("ip"), F.col("port"), urls.allowed_ranges("10.0.0.0/9, 192.168.0.0/18"))
    return pages.select("page_id", ip.alias("ip"), port.alias("port")).select("page_id", "ip", policy["decision"].alias("decision"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
