"""Merging and ranking of result lists of several engines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import round_half_up, terms
from lexiforge.functions.urls import canonical_url, domain, is_google_redirect, strip_www
from lexiforge.operators.bm25 import inverse_frequency, saturation
from lexiforge.sources.work import stored

#: Hosts by kind.
COMMUNITY_HOSTS = ["dev.to", "hashnode.com", "medium.com", "reddit.com", "stackoverflow.com", "stackexchange.com", "substack.com"]
NEWS_HOSTS = ["arstechnica.com", "techcrunch.com", "theverge.com", "venturebeat.com", "wired.com", "zdnet.com"]
SOCIAL_HOSTS = ["facebook.com", "instagram.com", "linkedin.com", "pinterest.com", "tiktok.com", "twitter.com", "x.com"]
#: Weight of an engine's hit; priority, tier and boost of a source type.
ENGINE_WEIGHTS = {"google": 10, "tinyfish": 4, "parallel": 4, "firecrawl": 3, "bing": 3, "reddit": 2, "ddg": 2, "brave": 2, "yahoo": 1}
TYPE_PRIORITY = {"official-docs": 5, "repo": 4, "academic": 4, "maintainer-blog": 3, "website": 2, "community": 1, "news": 0, "social": -6}
TIER = {"official-docs": "authoritative", "academic": "authoritative", "repo": "credible", "maintainer-blog": "credible", "news": "mixed", "website": "mixed", "community": "community", "social": "community"}
TIER_BOOST = {"authoritative": 0.1, "credible": 0.05, "mixed": 0.0, "community": 0.0}
#: Words of a query and the official sites they stand for.
PREFERRED_DOMAINS = [
    (r"\b(openai|gpt|chatgpt)\b", ["openai.com", "platform.openai.com", "help.openai.com"]),
    (r"\b(anthropic|claude)\b", ["anthropic.com", "docs.anthropic.com"]),
    (r"\bbun\b", ["bun.sh", "bun.com"]),
    (r"\b(next\.js|nextjs)\b", ["nextjs.org", "vercel.com"]),
    (r"\bplaywright\b", ["playwright.dev"]),
    (r"\bsupabase\b", ["supabase.com", "supabase.io"]),
    (r"\bprisma\b", ["prisma.io"]),
    (r"\btailwind\b", ["tailwindcss.com"]),
    (r"\bvite\b", ["vitejs.dev", "vite.dev"]),
    (r"\bastro\b", ["astro.build"]),
    (r"\bsvelte\b", ["svelte.dev"]),
    (r"\bsolid(js)?\b", ["solidjs.com"]),
    (r"\b(vue|nuxt)\b", ["vuejs.org", "nuxt.com"]),
    (r"\breact(\s*native)?\b", ["react.dev", "reactnative.dev"]),
    (r"\bangular\b", ["angular.io", "angular.dev"]),
    (r"\bnode(\.js)?\b", ["nodejs.org", "nodejs.dev", "npmjs.com"]),
    (r"\b(golang|go)\b", ["go.dev", "golang.org", "pkg.go.dev"]),
    (r"\bdeno\b", ["deno.land", "deno.com"]),
    (r"\bfresh\b", ["fresh.deno.dev"]),
    (r"\btypescript\b", ["typescriptlang.org"]),
    (r"\bpython\b", ["python.org", "docs.python.org"]),
    (r"\brust\b", ["rust-lang.org", "docs.rs", "crates.io"]),
    (r"\bzig\b", ["ziglang.org"]),
    (r"\bdocker\b", ["docker.com", "docs.docker.com", "hub.docker.com"]),
    (r"\b(kubernetes|k8s)\b", ["kubernetes.io", "k8s.io"]),
    (r"\bpostgres(ql)?\b", ["postgresql.org", "neon.tech", "supabase.com"]),
    (r"\bredis\b", ["redis.io"]),
    (r"\bsqlite\b", ["sqlite.org"]),
    (r"\bcloudflare\b", ["developers.cloudflare.com", "cloudflare.com"]),
    (r"\bvercel\b", ["vercel.com", "nextjs.org"]),
    (r"\bnetlify\b", ["netlify.com", "docs.netlify.com"]),
    (r"\bstripe\b", ["stripe.com", "docs.stripe.com"]),
    (r"\bgithub\b", ["github.com", "docs.github.com"]),
    (r"\bgitlab\b", ["gitlab.com", "docs.gitlab.com"]),
    (r"\baws\b", ["aws.amazon.com", "docs.aws.amazon.com"]),
    (r"\bazure\b", ["azure.microsoft.com", "learn.microsoft.com"]),
    (r"\b(gcp|google cloud)\b", ["cloud.google.com", "developers.google.com"]),
    (r"\b(gemini|google ai)\b", ["ai.google.dev", "developers.google.com"]),
]
PREFERRED_BONUS, TYPE_WEIGHT, CONSENSUS, RELEVANCE_TOP, DOMAIN_CAP = 8, 2, 2, 30, 2
#: Rerank profiles; a rule counts once if any of its lists hits.
PROFILES = {
    "docs-first": [
        {"domainMarkers": ["docs.", "developer.", "developers.", "api."], "weight": 6, "label": "docs-subdomain"},
        {"urlMarkers": ["/reference/", "/docs/", "/api/"], "weight": 4, "label": "docs-path"},
        {"titleTerms": ["documentation", "reference", "docs"], "weight": 3, "label": "docs-title"},
        {"domains": NEWS_HOSTS, "weight": -4, "label": "news-demote"},
        {"domains": SOCIAL_HOSTS, "weight": -6, "label": "social-demote"},
    ],
    "research": [
        {"domains": ["arxiv.org", "doi.org", "semanticscholar.org", "github.com", "gitlab.com"], "weight": 6, "label": "academic-repo"},
        {"urlMarkers": ["/paper/", "/pdf/", "/abs/"], "weight": 3, "label": "academic-path"},
        {"titleTerms": ["paper", "study", "research", "proceedings"], "weight": 3, "label": "research-title"},
        {"domains": SOCIAL_HOSTS, "weight": -4, "label": "social-demote"},
    ],
    "news-balanced": [
        {"domains": NEWS_HOSTS, "weight": 6, "label": "news-boost"},
        {"titleTerms": ["breaking", "announces", "announcement"], "weight": 2, "label": "news-title"},
    ],
}


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def at_host(name: Column, hosts: list[str]) -> Column:
    """The host is one of these or a subdomain of one."""
    return F.coalesce(_any([(name == h) | name.endswith("." + h) for h in hosts]), F.lit(False))


def contains_any(text: Column, parts: list[str]) -> Column:
    return F.coalesce(_any([text.contains(p) for p in parts]), F.lit(False))


def source_type(site: Column, title: Column, url: Column) -> Column:
    d, t, u = strip_www(F.coalesce(site, F.lit(""))), F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    docs = _any([d.startswith(p) for p in ("docs.", "developer.", "developers.", "api.")])
    return (
        F.when(d.isin("github.com", "gitlab.com"), "repo")
        .when(d.isin("arxiv.org", "doi.org") | at_host(d, ["semanticscholar.org"]) | contains_any(u, ["/paper/", "/pdf/"]), "academic")
        .when(at_host(d, SOCIAL_HOSTS), "social")
        .when(at_host(d, COMMUNITY_HOSTS), "community")
        .when(at_host(d, NEWS_HOSTS), "news")
        .when(docs | contains_any(t, ["documentation", "docs", "reference"]) | contains_any(u, ["/docs/", "/reference/", "/api/"]), "official-docs")
        .when(d.startswith("blog.") | u.contains("/blog/"), "maintainer-blog")
        .otherwise("website")
    )


def lookup(key: Column, table: dict, default=None) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def type_priority(kind: Column) -> Column:
    return lookup(kind, TYPE_PRIORITY, 0)


def trust_tier(kind: Column) -> Column:
    return lookup(kind, TIER, "mixed")


def tier_boost(tier: Column) -> Column:
    return lookup(tier, TIER_BOOST, 0.0)


def prefers(query: Column, site: Column) -> Column:
    """Whether the query's words stand for the site."""
    q, d = F.lower(query), strip_www(site)
    return _any([q.rlike(pattern) & at_host(d, domains) for pattern, domains in PREFERRED_DOMAINS])


def profile_matches(rules: list[dict], site: Column, title: Column, url: Column) -> Column:
    """label and weight of every rule that fires."""
    d, t, u = strip_www(F.coalesce(site, F.lit(""))), F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    fired = []
    for rule in rules:
        low = lambda name, rule=rule: [x.lower() for x in rule.get(name) or []]
        hit = at_host(d, low("domains")) | contains_any(d, low("domainMarkers")) | contains_any(u, low("urlMarkers")) | contains_any(t, low("titleTerms"))
        first = next((x for name in ("domains", "domainMarkers", "urlMarkers", "titleTerms") for x in rule.get(name) or []), "rule")
        label = rule.get("label") or f"{'boost' if rule['weight'] >= 0 else 'demote'}:{first}"
        fired.append(F.when(hit, F.struct(F.lit(label).alias("label"), F.lit(int(rule["weight"])).alias("weight"))))
    return F.array_compact(F.array(*fired)) if fired else F.array().cast("array<struct<label:string,weight:int>>")


def profile_bonus(matches: Column) -> Column:
    return F.aggregate(matches, F.lit(0), lambda a, m: a + m["weight"])


def merge_hits(hits: DataFrame, key: Column | None = None) -> DataFrame:
    """hits (query, engine, rank, url, title, snippet, domain, weight): one row for each query and canonical URL, or ``key``.

    weights of all entries add up, each further entry adds consensus, and the
    heaviest entry (the first on ties) gives title, snippet and domain.
    """
    keyed = hits.withColumn("key", canonical_url(F.col("url")) if key is None else key)
    best = F.max_by(F.struct("title", "snippet", "domain"), F.struct("weight", (-F.col("rank")).alias("r"), "engine"))
    merged = keyed.groupBy("query", "key").agg(F.sum("weight").alias("weights"), F.count("*").alias("entries"), F.array_sort(F.collect_set("engine")).alias("engines"), best.alias("best"))
    return merged.select(
        "query",
        F.col("key").alias("url"),
        "best.title",
        "best.snippet",
        F.coalesce("best.domain", domain(F.col("key")), F.lit("")).alias("domain"),
        "engines",
        (F.col("weights") + CONSENSUS * F.greatest(F.col("entries") - 1, F.lit(0))).alias("engine_score"),
    )


def relevance(rows: DataFrame, keys: list[str], query_col: str, text: Column, within: list[str]) -> DataFrame:
    """keys and BM25 of the query against the text, among the rows that agree in ``within``; these have one query.

    Only what the query asks for is moved: a row's own terms are counted where it lies.
    """
    both = F.array(F.struct(terms(text).alias("t"), terms(F.col(query_col)).alias("q")))
    found = F.transform(both, lambda x: F.struct(F.size(x["t"]).alias("len"), F.filter(x["t"], lambda w: F.array_contains(x["q"], w)).alias("hits")))[0]
    kept = list(dict.fromkeys([*keys, *within, query_col]))
    words = stored(rows.select(*kept, found.alias("_t")).select(*kept, F.col("_t.len").alias("_len"), F.col("_t.hits").alias("_hits")), "hits")
    size = words.groupBy(*within).agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"))
    tf = words.select(*keys, "_len", F.explode("_hits").alias("_w")).groupBy(*keys, "_len", "_w").agg(F.count("*").alias("_tf"))
    asked = words.select(*within, query_col).distinct().select(*within, F.explode(terms(F.col(query_col))).alias("_w")).groupBy(*within, "_w").agg(F.count("*").alias("_mult"))
    found = tf.join(asked, [*within, "_w"])
    df = found.groupBy(*within, "_w").agg(F.count("*").alias("_df"))
    part = F.col("_mult") * inverse_frequency(F.col("_n"), F.col("_df")) * saturation(F.col("_tf"), F.col("_len"), F.col("_avg"))
    return found.join(df, [*within, "_w"]).join(size, within).groupBy(*keys).agg(F.sum(part).alias("relevance"))


def rank_results(hits: DataFrame, profile: str | list[dict] | None = None, domain_cap: int = DOMAIN_CAP, limit: int | None = None) -> DataFrame:
    """Merged hits in order: query, position, url, domain, source_type, score.

    The BM25 part is only added to the 30 best of a query by the other parts. A site's rows beyond the cap go to the end.
    """
    return _placed(merge_hits(hits), profile, domain_cap, limit).select("query", "position", "url", "domain", "source_type", "score")


def rank_in_two_stages(hits: DataFrame, others: DataFrame, profile: str | list[dict] | None = None, domain_cap: int = DOMAIN_CAP, limit: int | None = None) -> DataFrame:
    """``rank_results`` of what web engines found (``hits``) and of what other providers found (``others``).

    The engines' hits are merged by their URLs as they stand and ranked first. That list then counts as one engine,
    ``http``, of weight 1, and is merged with the others by canonical URL and scored anew.
    """
    first = _placed(merge_hits(hits, F.col("url")), profile, domain_cap, None)
    web = first.select("query", F.lit("http").alias("engine"), F.col("position").alias("rank"), "url", "title", "snippet", "domain", F.lit(1).alias("weight"))
    both = web.unionByName(others.select("query", "engine", "rank", "url", "title", "snippet", "domain", "weight"))
    return rank_results(both, profile, domain_cap, limit)


def _placed(rows: DataFrame, profile: str | list[dict] | None, domain_cap: int, limit: int | None) -> DataFrame:
    """Merged hits with source_type, score and position."""
    rules = PROFILES.get(profile.lower()) if isinstance(profile, str) else profile
    rows = rows.withColumn("source_type", source_type(F.col("domain"), F.col("title"), F.col("url")))
    score = F.col("engine_score") + TYPE_WEIGHT * type_priority(F.col("source_type")) + F.when(prefers(F.col("query"), F.col("domain")), PREFERRED_BONUS).otherwise(0)
    if rules:
        score = score + profile_bonus(profile_matches(rules, F.col("domain"), F.col("title"), F.col("url")))
    order = Window.partitionBy("query").orderBy(F.desc("interim"), "url")
    rows = rows.withColumn("interim", score.cast("double")).withColumn("place", F.row_number().over(order))
    top = rows.where(F.col("place") <= RELEVANCE_TOP)
    bonus = relevance(top, ["query", "url"], "query", F.concat_ws(" ", "title", "snippet"), ["query"])
    rows = rows.join(bonus, ["query", "url"], "left").withColumn("score", F.round(F.col("interim") + F.coalesce("relevance", F.lit(0.0)), 9))
    out = diversify(rows, ["query"], [F.desc("score"), F.col("url")], F.col("domain"), domain_cap)
    if limit is not None:
        out = out.where(F.col("position") <= limit)
    return out


def diversify(rows: DataFrame, within: list[str], order: list, site: Column, cap: int = DOMAIN_CAP) -> DataFrame:
    """``rows`` with position: in order, but a site's rows beyond the cap come after all others."""
    rows = rows.withColumn("_site", strip_www(F.coalesce(site, F.lit(""))))
    beyond = F.row_number().over(Window.partitionBy(*within, "_site").orderBy(*order)) > cap if cap > 0 else F.lit(False)
    rows = rows.withColumn("_beyond", beyond)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*within).orderBy("_beyond", *order))).drop("_site", "_beyond")


def plain_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def drop_redirects(results: DataFrame) -> DataFrame:
    """Without the redirect rows (url, title, domain) whose page is there directly: same site, and one title begins with the other's words."""
    site, title = strip_www(F.coalesce(F.col("domain"), F.lit(""))), plain_title(F.col("title"))
    direct = results.where(~is_google_redirect(F.col("url"))).select(site.alias("_site"), title.alias("_title")).where("_title <> ''").distinct()
    mine = results.withColumns({"_s": F.when(is_google_redirect(F.col("url")), site), "_t": title})
    alike = (F.col("_t") == F.col("_title")) | F.col("_t").startswith(F.concat("_title", F.lit(" "))) | F.col("_title").startswith(F.concat("_t", F.lit(" ")))
    return mine.join(direct, (F.col("_s") == F.col("_site")) & (F.col("_s") != "") & (F.col("_t") != "") & alike, "left_anti").drop("_s", "_t")


def fuse_ranks(lists: DataFrame, trust: bool = False) -> DataFrame:
    """lists (query, rank, url, title, domain, engine): one ranked list by reciprocal rank fusion.

    Every further query that found a page adds one half; with ``trust`` its tier adds a little.
    """
    keyed = lists.withColumn("key", canonical_url(F.col("url")))
    first = F.struct("query", "rank")
    merged = keyed.groupBy("key").agg(
        F.min_by("url", first).alias("url"),
        F.min_by("title", first).alias("title"),
        F.min_by("domain", first).alias("domain"),
        F.array_sort(F.collect_set("engine")).alias("engines"),
        F.countDistinct("query").alias("n_queries"),
        F.min("rank").alias("best_rank"),
        F.sum(1 / F.col("rank")).alias("fused"),
    )
    score = F.col("fused") + 0.5 * (F.col("n_queries") - 1)
    if trust:
        score = score + tier_boost(trust_tier(source_type(F.col("domain"), F.col("title"), F.col("url"))))
    return merged.withColumn("score", round_half_up(score)).withColumn("primary", is_primary(F.col("domain")))


#: Who publishes first hand: ends of names, whole names, names with all below them, and first labels.
PRIMARY_SUFFIXES = [".gov", ".edu", ".mil"]
PRIMARY_SITES = ["w3.org", "ietf.org", "rfc-editor.org", "iso.org", "wikipedia.org"]
PRIMARY_DOMAINS = ["github.com", "developer.mozilla.org", "docs.python.org", "nodejs.org", "npmjs.com", "pypi.org", "arxiv.org", "readthedocs.io"]
PRIMARY_LABELS = ["docs.", "developer.", "developers.", "learn."]


def is_primary(site: Column) -> Column:
    d = strip_www(site)
    below = [(d == x) | d.endswith(f".{x}") for x in PRIMARY_DOMAINS]
    return F.coalesce(_any([*(d.endswith(s) for s in PRIMARY_SUFFIXES), d.isin(PRIMARY_SITES), *below, *(d.startswith(x) for x in PRIMARY_LABELS)]), F.lit(False))


def trust_profile(sources: DataFrame, key: str = "query") -> DataFrame:
    """sources (key, domain, source_type, reachability): tiers, diversity and caveats of each set."""
    rows = sources.withColumns({"tier": trust_tier(F.col("source_type")), "site": F.nullif(strip_www(F.col("domain")), F.lit(""))})
    tiers = [F.count_if(F.col("tier") == t).alias(t) for t in TIER_BOOST]
    whole = rows.groupBy(key).agg(
        F.count("*").alias("n"), *tiers, F.countDistinct("source_type").alias("types"), F.coalesce(F.bool_or(F.col("reachability").isin("skipped", "dead")), F.lit(False)).alias("blocked")
    )
    sites = rows.where("site is not null").groupBy(key, "site").agg(F.count("*").alias("c")).groupBy(key).agg(F.count("*").alias("unique_domains"), F.max("c").alias("top"))
    out = whole.join(sites, key, "left").withColumns({"unique_domains": F.coalesce("unique_domains", F.lit(0)), "top_domain_share": F.coalesce(F.col("top") / F.col("n"), F.lit(0.0))})
    caveats = F.array_compact(
        F.array(
            F.when(F.col("community") == F.col("n"), F.lit("community-only")),
            F.when((F.col("n") >= 2) & ((F.col("top_domain_share") > 0.5) | (F.col("types") == 1)), F.lit("low-diversity")),
            F.when(F.col("blocked"), F.lit("bot-check")),
        )
    )
    return out.select(key, *TIER_BOOST, "unique_domains", F.round("top_domain_share", 9).alias("top_domain_share"), F.array_join(caveats, ",").alias("caveats"))
