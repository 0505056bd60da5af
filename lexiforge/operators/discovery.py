"""Finding the pages of a site: sitemaps, robots, scope, recency and crawl."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import unescape_xml
from lexiforge.functions.urls import in_scope, is_asset

MOST_URLS = 5000


def sitemap_entries(sitemaps: DataFrame, xml_col: str = "xml") -> DataFrame:
    """``sitemaps`` exploded to loc and lastmod, each pair from one url block."""
    blocks = F.regexp_extract_all(F.col(xml_col), F.lit(r"(?is)<url>(.*?)</url>"), 1)
    rows = sitemaps.select(*(c for c in sitemaps.columns if c != xml_col), F.posexplode(blocks).alias("ord", "block"))
    inside = lambda tag: F.nullif(F.trim(unescape_xml(F.regexp_extract("block", rf"(?is)<{tag}>(.*?)</{tag}>", 1))), F.lit(""))
    return rows.withColumns({"loc": inside("loc"), "lastmod": inside("lastmod")}).drop("block").where("loc is not null")


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike("(?i)<sitemapindex[ >]")


def robots_sitemaps(robots: Column) -> Column:
    """Targets of the Sitemap lines of a robots.txt."""
    return F.regexp_extract_all(robots, F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(\S+)"), 1)


def llms_links(text: Column) -> Column:
    """Targets of the links of an llms.txt."""
    return F.regexp_extract_all(text, F.lit(r"\]\((https?://[^)\s]+)\)"), 1)


def entry_date(loc: Column, lastmod: Column) -> Column:
    """The date of an entry: a lastmod that is on a calendar, else a /YYYY/MM/ part of its path, else null."""
    stamp = F.try_to_date(F.nullif(F.regexp_extract(lastmod, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")
    year, month = (F.regexp_extract(loc, r"/((?:19|20)\d{2})/(\d{1,2})(?:/|$)", k) for k in (1, 2))
    slug = F.try_to_date(F.when(year != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-01"))), "yyyy-MM-dd")
    real = lambda d: F.when(d > F.to_date(F.lit("1970-01-01")), d)
    return F.coalesce(real(stamp), real(slug))


def rank_by_recency(entries: DataFrame, within: list[str], order: str = "ord") -> DataFrame:
    """``entries`` with position: newest first if more than half are dated (undated last), else as they were."""
    dated = entries.withColumn("date", entry_date(F.col("loc"), F.col("lastmod")))
    share = dated.groupBy(*within).agg((F.count("date") * 2 > F.count("*")).alias("_by_date"))
    rows = dated.join(share, within)
    newest = F.when(F.col("_by_date"), F.col("date"))
    place = Window.partitionBy(*within).orderBy(F.desc_nulls_last(newest), order)
    return rows.withColumn("position", F.row_number().over(place)).drop("_by_date")


def eligible(entries: DataFrame, origin: str, prefix: str = "/") -> DataFrame:
    """Pages of the scope, each once (the first stays), no assets."""
    rows = entries.where(in_scope(F.col("loc"), origin, prefix) & ~is_asset(F.col("loc")))
    return rows.groupBy("loc").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "loc"]), "ord").alias("r")).select("loc", "r.*")


def site_urls(entries: DataFrame, origin: str, prefix: str = "/", most: int = MOST_URLS, seed: str | None = None) -> DataFrame:
    """Eligible first, then ranked, then cut: the order of these steps is the contract. A ``seed`` comes first, once, and counts.

    The vote on dates is an aggregate, and the best ``most`` are a top-k: only they come together.
    """
    rows = eligible(entries, origin, prefix).withColumn("date", entry_date(F.col("loc"), F.col("lastmod")))
    if seed is not None:
        page = lambda u: F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/+$", "")
        rows = rows.where(page(F.col("loc")) != page(F.lit(seed)))
    by_date = rows.agg(F.count("date").alias("dated"), F.count("*").alias("n")).first()
    order = ([F.desc_nulls_last("date")] if by_date["dated"] * 2 > by_date["n"] else []) + [F.col("ord"), F.col("loc")]
    top = rows.orderBy(*order).limit(most if seed is None else most - 1)
    top = top.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # at most ``most`` rows
    if seed is None:
        return top
    first = entries.sparkSession.range(1).select(F.lit(seed).alias("loc"), F.lit(1).alias("position"))
    return first.unionByName(top.withColumn("position", F.col("position") + 1), allowMissingColumns=True)


def best_strategy(found: DataFrame) -> DataFrame:
    """found (strategy, loc, lastmod): the strategy with most pages, the newest page on ties."""
    counted = found.groupBy("strategy").agg(F.count("*").alias("n"), F.max(entry_date(F.col("loc"), F.col("lastmod"))).alias("newest"))
    return counted.orderBy(F.desc("n"), F.desc_nulls_last("newest"), "strategy").limit(1)


def crawl(links: DataFrame, seeds: DataFrame, depth: int, stored) -> DataFrame:
    """url and depth of the pages that ``depth`` steps over ``links`` (src, dst) reach from the seeds.

    ``stored``: cuts the lineage of a DataFrame (a table or a reliable checkpoint), once for each step. A step stores what it adds.
    """
    steps = [stored(seeds.select("url").distinct().withColumn("depth", F.lit(0)))]
    for step in range(1, depth + 1):
        edge = steps[-1].join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        seen = reduce(DataFrame.unionByName, steps)
        steps.append(stored(edge.join(seen, "url", "left_anti").withColumn("depth", F.lit(step))))
    return reduce(DataFrame.unionByName, steps)


#: What a path of a repository that is not read has in it, in any case.
EXCLUDED_PATHS = (
    "node_modules/ vendor/ venv/ .venv/ __pycache__/ pycache/ .pytest_cache/ .mypy_cache/ .tox/ .cache/ .tmp/ .tmp .min. .pyc .pyo .pyd .so .dll .class "
    ".jpg .jpeg .png .gif .ico .svg .ttf .woff .woff2 .webp .mp4 .mp3 .webm .mov .avi .zip .tar .gz .tgz .lockb yarn.lock pnpm-lock.yaml package-lock.json "
    "Cargo.lock dist/ build/ target/ .next/ .nuxt/ .output/ out/ .vscode/ .idea/ .git/ .github/ISSUE_TEMPLATE/ docs/ .log .dmg .pkg .exe .deb .rpm .whl "
    ".jar"
).split()


def excluded_path(path: Column) -> Column:
    low = F.lower(path)
    return F.exists(F.array(*(F.lit(p.lower()) for p in EXCLUDED_PATHS)), lambda p: F.contains(low, p))


def repository_census(paths: DataFrame) -> DataFrame:
    """paths (repo, path; a trailing slash is a folder): files and folders of each repository, without paths that are not read."""
    folder = F.col("path").endswith("/")
    return paths.where(~excluded_path(F.col("path"))).groupBy("repo").agg(F.count_if(~folder).alias("files"), F.count_if(folder).alias("folders"))


def repository_tree(paths: DataFrame) -> DataFrame:
    """paths (repo, path) with line and position: folders first, then by name, indented by depth."""
    names = F.filter(F.split("path", "/"), lambda s: s != "")
    last_is_folder = F.col("path").endswith("/")
    place = F.transform(names, lambda s, i: F.struct(F.when((i < F.size(names) - 1) | last_is_folder, 0).otherwise(1).alias("file"), s.alias("name")))
    rows = paths.withColumns({"_place": place, "_n": F.size(names)}).where("_n > 0")
    line = F.concat(F.repeat(F.lit("  "), F.col("_n") - 1), F.element_at(names, -1), F.when(last_is_folder, "/").otherwise(""))
    order = Window.partitionBy("repo").orderBy("_place")
    return rows.withColumns({"line": line, "position": F.row_number().over(order)}).drop("_place", "_n")


#: Files that tell how a repository is built, and what they stand for.
SIGNALS = {
    "docker": [(r"^(Dockerfile|docker-compose\.(yml|yaml)|\.dockerignore)$", "yes")],
    "ci": [
        (r"^\.github/workflows/", "GitHub Actions"), (r"^\.gitlab-ci\.yml$", "GitLab CI"), (r"^Jenkinsfile$", "Jenkins"), (r"^\.circleci/", "CircleCI"),
        (r"^\.travis\.yml$", "Travis CI"), (r"^azure-pipelines\.yml$", "Azure Pipelines"), (r"^bitbucket-pipelines\.yml$", "Bitbucket Pipelines"),
    ],
    "tests": [
        (r"^jest\.config\.", "Jest"), (r"^vitest\.config\.", "Vitest"), (r"^playwright\.config\.", "Playwright"), (r"^cypress\.config\.", "Cypress"),
        (r"^(.*/)?conftest\.py$", "pytest"), (r"^pytest\.ini$", "pytest"), (r"^\.mocharc\.", "Mocha"), (r"^karma\.conf\.", "Karma"),
    ],
    "monorepo": [(r"^lerna\.json$", "Lerna"), (r"^nx\.json$", "Nx"), (r"^turbo\.json$", "Turborepo"), (r"^pnpm-workspace\.yaml$", "pnpm workspaces"), (r"^rush\.json$", "Rush")],
    "managers": [
        (r"(^|/)package-lock\.json$", "npm"), (r"(^|/)yarn\.lock$", "yarn"), (r"(^|/)pnpm-lock\.yaml$", "pnpm"), (r"(^|/)bun\.lockb$", "bun"), (r"(^|/)uv\.lock$", "uv"),
        (r"(^|/)poetry\.lock$", "poetry"), (r"(^|/)Pipfile\.lock$", "pipenv"), (r"(^|/)Cargo\.lock$", "cargo"), (r"(^|/)Gemfile\.lock$", "bundler"),
    ],
    "security": [(r"^SECURITY\.md$", "SECURITY.md"), (r"^\.env$", ".env committed"), (r"^\.github/dependabot\.(yml|yaml)$", "Dependabot")],
}


def repository_signals(paths: DataFrame) -> DataFrame:
    """paths (repo, path; folders end with a slash): of each repository the sorted labels of each kind of signal.

    Only files count, but for a folder of tests where no test tool is named. Labels are few, so a large repository gathers a short set.
    """
    file = ~F.col("path").endswith("/")
    labels = lambda kind: F.array_compact(F.array(*(F.when(file & F.col("path").rlike(p), F.lit(name)) for p, name in SIGNALS[kind])))
    per_path = paths.select("repo", *(labels(kind).alias(kind) for kind in SIGNALS), F.col("path").rlike("^(__tests__|tests?|spec)/").alias("in_tests"), (file & F.col("path").endswith("/package.json")).alias("package"))
    union = lambda kind: F.array_sort(F.array_distinct(F.flatten(F.collect_set(kind)))).alias(kind)
    out = per_path.groupBy("repo").agg(*(union(kind) for kind in SIGNALS), F.max("in_tests").alias("in_tests"), F.count_if("package").alias("packages"))
    none = lambda kind: F.size(kind) == 0
    tests = F.when(none("tests") & F.col("in_tests"), F.array(F.lit("(test dir present)"))).otherwise(F.col("tests"))
    mono = F.when(none("monorepo") & (F.col("packages") > 1), F.array(F.lit("multi-package"))).otherwise(F.col("monorepo"))
    return out.withColumns({"tests": tests, "monorepo": mono}).drop("in_tests", "packages")


#: Sitemaps that one may name, fetches of a site, and how deep sitemaps may name others.
MOST_CHILDREN, MOST_FETCHES, MOST_DEPTH = 50, 100, 3


def sitemap_tree(sites: DataFrame, bodies: DataFrame, stored, most_fetches: int = MOST_FETCHES, most_depth: int = MOST_DEPTH, most_children: int = MOST_CHILDREN, most: int | None = MOST_URLS) -> tuple[DataFrame, DataFrame]:
    """site, position, loc, lastmod of the pages that the sitemaps of many sites name, and site, fetch, url, depth of what was fetched.

    ``sites``: site and origin; ``bodies``: url and text of what answers. A site's robots.txt names its first sitemaps; an index names
    more, at most ``most_children`` of the same origin each, down to ``most_depth``. All branches of a site share ``most_fetches``
    fetches, level by level in the order in which they are named; robots.txt is the first. What does not answer has been fetched too.
    ``most``: the entries that count of a sitemap and of a site; None for all. ``stored`` cuts the lineage, once for each level.
    """
    counts = F.lit(True) if most is None else F.col("position") <= most
    texts = bodies.select(F.col("url").alias("_url"), F.col("text").alias("body")).dropDuplicates(["_url"])
    own = F.concat("origin", F.lit("/robots.txt"))
    level = stored(sites.select("site", "origin", F.lit(1).cast("long").alias("fetch"), own.alias("url"), F.lit(-1).alias("depth")).where(F.lit(most_fetches) > 0))
    fetched, entries = [level], []
    for depth in range(most_depth + 1):
        answered = level.join(texts, F.col("url") == F.col("_url")).drop("_url")
        if depth == 0:
            named = robots_sitemaps(F.col("body"))
        else:
            pages = sitemap_entries(answered.where(~_is_index(F.col("body"))).select("site", "fetch", F.col("body").alias("xml")))
            entries.append(pages)
            named = F.when(_is_index(F.col("body")), F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1))
        approved = lambda u: u.startswith(F.concat(F.col("origin"), F.lit("/"))) | (u == F.col("origin"))
        children = F.slice(F.filter(F.transform(named, lambda u: unescape_xml(F.trim(u))), approved), 1, most_children)
        rows = answered.select("site", "origin", F.col("fetch").alias("_from"), F.posexplode(children).alias("_at", "url"))
        done = reduce(DataFrame.unionByName, fetched).groupBy("site").agg(F.count("*").alias("_done"))  # at most most_fetches a site
        order = F.row_number().over(Window.partitionBy("site").orderBy("_from", "_at"))
        rows = rows.join(done, "site").withColumn("fetch", (F.col("_done") + order).cast("long")).where(F.col("fetch") <= most_fetches)
        level = stored(rows.select("site", "origin", "fetch", "url", F.lit(depth).alias("depth")))
        fetched.append(level)
    answered = level.join(texts, F.col("url") == F.col("_url"))
    entries.append(sitemap_entries(answered.where(~_is_index(F.col("body"))).select("site", "fetch", F.col("body").alias("xml"))))
    every = reduce(DataFrame.unionByName, entries)
    # each sitemap's best first, then those of the site; a page counts where it is named first
    each = rank_by_recency(every, ["site", "fetch"]).where(counts)
    first = each.groupBy("site", "loc").agg(F.min_by(F.struct("fetch", F.col("position").alias("at"), "lastmod"), F.struct("fetch", "position")).alias("f")).select("site", "loc", "f.*")
    ranked = rank_by_recency(first.withColumn("ord", F.struct("fetch", "at")), ["site"]).where(counts)
    return ranked.select("site", "position", "loc", "lastmod"), reduce(DataFrame.unionByName, fetched).select("site", "fetch", "url", "depth")


def _is_index(xml: Column) -> Column:
    return xml.contains("<sitemapindex") | (xml.contains("<sitemap>") & ~xml.contains("<urlset"))


#: What stands around a page's navigation, as in ``articles.matches``.
NAVIGATION = ["nav", "aside", "[class*=sidebar]", "[class*=Sidebar]", "[class*=navigation]", "[class*=toc]", "[class*=menu]", "[role=navigation]"]


def navigation_links(rows: DataFrame, urls: DataFrame) -> DataFrame:
    """page and url of the links inside a page's navigation, each once and without query and fragment, and of the page itself.

    ``rows``: ``elements``; ``urls``: page and url. Assets and links that are no web pages are left out.
    """
    from lexiforge.operators.articles import any_of
    from lexiforge.operators.html import resolve

    around = rows.where(any_of(NAVIGATION)).select("page", F.col("place").alias("around"))
    links = rows.where((F.col("tag") == "a") & F.col("attributes")["href"].isNotNull()).select("page", F.explode("ancestors").alias("around"), F.col("attributes")["href"].alias("href"))
    inside = links.join(around, ["page", "around"]).select("page", "href").distinct().join(urls, "page")
    found = inside.where(~F.col("href").startswith("#")).select("page", F.regexp_replace(resolve(F.col("href"), F.col("url")), "[?#].*$", "").alias("url")).where("url is not null")
    return found.where(~is_asset(F.col("url"))).unionByName(urls.select("page", F.regexp_replace("url", "#.*$", "").alias("url"))).distinct()
