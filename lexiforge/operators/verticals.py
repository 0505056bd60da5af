"""API answers as Markdown records: which fields of which site, rendered by one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import unescape_xml

#: By site, its URL pattern (group 1 is the key) and its fields: label, JSON path, most characters or list items.
SPECS = {
    "npm": (r"^https?://(?:www\.)?npmjs\.com/package/((?:@[^/]+/)?[^/?#]+)", [("Description", "$.description", 500), ("Latest", "$.dist-tags.latest", 40), ("License", "$.license", 80), ("Homepage", "$.homepage", 300), ("Keywords", "$.keywords[*]", 30)]),
    "pypi": (r"^https?://pypi\.org/project/([^/?#]+)", [("Summary", "$.info.summary", 500), ("Version", "$.info.version", 40), ("Author", "$.info.author", 120), ("License", "$.info.license", 80), ("Requires", "$.info.requires_dist[*]", 30)]),
    "cratesio": (r"^https?://crates\.io/crates/([^/?#]+)", [("Description", "$.crate.description", 500), ("Newest", "$.crate.newest_version", 40), ("Downloads", "$.crate.downloads", 20), ("Repository", "$.crate.repository", 300), ("Keywords", "$.crate.keywords[*]", 30)]),
    "rubygems": (r"^https?://rubygems\.org/gems/([^/?#]+)", [("Info", "$.info", 500), ("Version", "$.version", 40), ("Authors", "$.authors", 200), ("Licenses", "$.licenses[*]", 10), ("Downloads", "$.downloads", 20)]),
    "packagist": (r"^https?://packagist\.org/packages/([^/]+/[^/?#]+)", [("Description", "$.package.description", 500), ("Type", "$.package.type", 40), ("Repository", "$.package.repository", 300)]),
    "pubdev": (r"^https?://pub\.dev/packages/([^/?#]+)", [("Description", "$.latest.pubspec.description", 500), ("Latest", "$.latest.version", 40), ("Published", "$.latest.published", 40), ("Homepage", "$.latest.pubspec.homepage", 300)]),
    "nuget": (r"^https?://(?:www\.)?nuget\.org/packages/([^/?#]+)", [("Description", "$.data[0].description", 500), ("Version", "$.data[0].version", 40), ("Downloads", "$.data[0].totalDownloads", 20), ("Tags", "$.data[0].tags[*]", 20)]),
    "hackernews": (r"^https?://news\.ycombinator\.com/item\?id=(\d+)", [("Title", "$.title", 300), ("Link", "$.url", 300), ("Author", "$.author", 80), ("Points", "$.points", 10), ("Type", "$.type", 20)]),
    "stackexchange": (r"^https?://(?:[a-z]+\.)?(?:stackoverflow|stackexchange|superuser|serverfault)\.com/questions/(\d+)", [("Title", "$.items[0].title", 300), ("Score", "$.items[0].score", 10), ("Views", "$.items[0].view_count", 12), ("Tags", "$.items[0].tags[*]", 10)]),
    "devto": (r"^https?://dev\.to/([^/]+/[^/?#]+)", [("Description", "$.description", 500), ("Author", "$.user.name", 120), ("Published", "$.published_at", 40), ("Reactions", "$.public_reactions_count", 10)]),
    "openlibrary": (r"^https?://openlibrary\.org/(?:works|authors)/(OL\w+)", [("Title", "$.title", 300), ("Name", "$.name", 300), ("Born", "$.birth_date", 40), ("Subjects", "$.subjects[*]", 15)]),
    "gitlab": (r"^https?://gitlab\.com/([^/]+/[^/?#]+)", [("Description", "$.description", 500), ("Stars", "$.star_count", 10), ("Default branch", "$.default_branch", 80), ("Topics", "$.topics[*]", 20)]),
    "gopackages": (r"^https?://pkg\.go\.dev/([^?#]+)", [("Latest", "$.Version", 80), ("Published", "$.Time", 40), ("VCS", "$.Origin.VCS", 20), ("Repository", "$.Origin.URL", 300), ("Commit", "$.Origin.Hash", 12)]),
    "reddit": (r"^https?://(?:www\.|old\.)?reddit\.com/(r/[^/]+/comments/[^/?#]+)", [("Title", "$[0].data.children[0].data.title", 300), ("Author", "$[0].data.children[0].data.author", 80), ("Subreddit", "$[0].data.children[0].data.subreddit", 80), ("Score", "$[0].data.children[0].data.score", 10), ("Comments", "$[0].data.children[0].data.num_comments", 10)]),
    "youtube": (r"^https?://(?:www\.|m\.)?(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|shorts/|embed/)|youtu\.be/)([A-Za-z0-9_-]{11})", [("Title", "$.videoDetails.title", 300), ("Channel", "$.videoDetails.author", 120), ("Seconds", "$.videoDetails.lengthSeconds", 10), ("Views", "$.videoDetails.viewCount", 20), ("Tags", "$.videoDetails.keywords[*]", 10)]),
    "arxiv": (r"^https?://(?:[a-z]+\.)?arxiv\.org/(?:abs/|pdf/|api/query\?(?:[^#]*&)?id_list=)(\d+\.\d+(?:v\d+)?)", [("Title", "<title>", 500), ("Published", "<published>", 40), ("Updated", "<updated>", 40), ("Authors", "<name>[*]", 1000), ("Categories", "term=[*]", 1000)]),
    "wikipedia": (r"^https?://[a-z-]+\.(?:m\.)?wikipedia\.org/wiki/([^?#]+)", [("Title", "$.parse.title", 300), ("Page", "$.parse.pageid", 20), ("Revision", "$.parse.revid", 20)]),
}


def _comment(x: Column) -> Column:
    body = F.replace(F.substring(x["data"]["body"], 1, 600), F.lit("\n"), F.lit("\n> "))
    points = F.coalesce(x["data"]["score"], F.lit(0)).cast("string")
    return F.when((x["kind"] == "t1") & (body != ""), F.concat(F.lit("**u/"), x["data"]["author"], F.lit("** ("), points, F.lit(" pts):\n> "), body))


#: By site, the lists that follow a record: heading, JSON path, type of an item, its line, and most items.
LISTS = {
    "reddit": ("## Top Comments", "$[1].data.children", "struct<kind:string,data:struct<author:string,score:long,body:string>>", _comment, 10),
    "youtube": ("## Transcript", "$.segments", "struct<text:string>", lambda x: x["text"], 100_000),
    "wikipedia": ("## Sections", "$.parse.sections", "struct<number:string,line:string>", lambda x: F.concat(F.lit("- "), x["number"], F.lit(" "), x["line"]), 1_000),
}
#: By site, the longer texts that follow a record: heading, JSON path or tag, and most characters.
TEXTS = {
    "reddit": ("## Selftext", "$[0].data.children[0].data.selftext", 100_000),
    "youtube": ("## Description", "$.videoDetails.description", 600),
    "arxiv": ("## Abstract", "<summary>", 100_000),
}


def vertical(url: Column) -> Column:
    """name and key of the first site whose pattern the URL has, else null."""
    found = F.lit(None).cast("struct<name:string,key:string>")
    for name, (pattern, _) in reversed(SPECS.items()):
        found = F.when(url.rlike(pattern), F.struct(F.lit(name).alias("name"), F.regexp_extract(url, pattern, 1).alias("key"))).otherwise(found)
    return found


def _listed(json: Column, path: str, most: int) -> Column:
    """The first items of a JSON array, and how many more there are."""
    items = F.from_json(F.get_json_object(json, path.removesuffix("[*]")), "array<string>")
    more = F.when(F.size(items) > most, F.concat(F.lit(" … and "), (F.size(items) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(items) > 0, F.concat(F.array_join(F.slice(items, 1, most), ", "), more))


def _entry(xml: Column) -> Column:
    """The first entry of a feed; all of it if it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(xml, r"(?s)<entry\b[^>]*>(.*?)</entry>", 1), F.lit("")), xml)


def _value(body: Column, path: str, most: int) -> Column:
    """What a JSON path, a tag of a feed's first entry, or all values of a tag or an attribute there hold."""
    if path.startswith("$"):
        return _listed(body, path, most) if path.endswith("[*]") else F.substring(F.get_json_object(body, path), 1, most)
    name = path.removesuffix("[*]").strip("<>=")
    pattern = rf"(?s)<{name}\b[^>]*>\s*(.*?)\s*</{name}>" if path.startswith("<") else rf"<category[^>]*\b{name}=\"([^\"]*)\""
    if path.endswith("[*]"):
        return F.substring(unescape_xml(F.array_join(F.regexp_extract_all(_entry(body), F.lit(pattern), F.lit(1)), ", ")), 1, most)
    return F.substring(unescape_xml(F.regexp_extract(_entry(body), pattern, 1)), 1, most)


def render_lists(body: Column, name: str) -> list[Column]:
    """The longer text and the list that follow a site's record, where it has them."""
    parts = []
    if name in TEXTS:
        heading, path, most = TEXTS[name]
        text = _value(body, path, most)
        parts.append(F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"\n{heading}\n\n"), text)))
    if name in LISTS:
        heading, path, item, line, most = LISTS[name]
        items = F.slice(F.from_json(F.get_json_object(body, path), f"array<{item}>"), 1, most)
        lines = F.array_compact(F.transform(items, line))
        parts.append(F.when(F.size(lines) > 0, F.concat(F.lit(f"\n{heading}\n\n"), F.array_join(lines, "\n"))))
    return parts


def render_record(title: Column, json: Column, fields: list[tuple[str, str, int]]) -> Column:
    """A heading and a bullet for each field that is there."""
    bullets = []
    for label, path, most in fields:
        value = _value(json, path, most)
        bullets.append(F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"- **{label}:** "), value)))
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), *bullets)


def render_answers(answers: DataFrame) -> DataFrame:
    """answers (url, body): vertical, key and markdown of those that a site's spec covers."""
    rows = answers.withColumn("v", vertical(F.col("url"))).where("v is not null").select("*", F.col("v.name").alias("vertical"), F.col("v.key").alias("key")).drop("v")
    text = F.lit(None).cast("string")
    for name, (_, fields) in SPECS.items():
        record = F.concat_ws("\n", render_record(F.col("key"), F.col("body"), fields), *render_lists(F.col("body"), name))
        text = F.when(F.col("vertical") == name, record).otherwise(text)
    return rows.withColumn("markdown", text)


def hotspot_groups(answers: DataFrame) -> DataFrame:
    """answers (url, body of a list of security hotspots): url, category, n, high, medium and low of each category."""
    item = F.explode(F.from_json(F.get_json_object("body", "$.hotspots"), "array<struct<securityCategory:string,vulnerabilityProbability:string>>"))
    rows = answers.select("url", item.alias("h")).select("url", F.coalesce("h.securityCategory", F.lit("other")).alias("category"), F.upper("h.vulnerabilityProbability").alias("level"))
    counts = [F.count_if(F.col("level") == level.upper()).alias(level) for level in ("high", "medium", "low")]
    return rows.groupBy("url", "category").agg(F.count("*").alias("n"), *counts)
