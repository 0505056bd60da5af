import random
import re
from collections import deque

from lexiforge.operators import discovery, elements
from lexiforge.sources.work import stored


def xml(kind, rows):
    if kind == "index":
        return "<sitemapindex>" + "".join(f"<sitemap><loc> {u.replace('&', '&amp;')} </loc></sitemap>" for u in rows) + "</sitemapindex>"
    return "<urlset>" + "".join(f"<url><loc>{u}</loc>" + (f"<lastmod>{d}</lastmod>" if d else "") + "</url>" for u, d in rows) + "</urlset>"


def by_queue(origin, bodies, most_fetches, most_depth, most_children):
    """Fetches and pages of one site, with a queue and one counter."""
    fetched, pages = [], []
    queue = deque([(f"{origin}/robots.txt", -1)])
    while queue and len(fetched) < most_fetches:
        url, depth = queue.popleft()
        fetched.append((url, depth))
        body = bodies.get(url)
        if body is None:
            continue
        if depth == -1:
            named = re.findall(r"(?im)^[ \t]*sitemap:[ \t]*(\S+)", body)
        elif "<sitemapindex" in body:
            named = [u.replace("&amp;", "&") for u in re.findall(r"<loc>\s*(.*?)\s*</loc>", body)]
        else:
            named = []
            pages += re.findall(r"<url><loc>(.*?)</loc>", body)
        if depth < most_depth:
            queue.extend((u, depth + 1) for u in [u for u in named if u.startswith(origin + "/")][:most_children])
    return fetched, set(pages)


def test_trees_with_cycles(spark):
    rng = random.Random(17)
    sites, bodies = [], {}
    for s in range(12):
        origin = f"https://s{s}.org"
        sites.append((s, origin))
        maps = [f"{origin}/map{k}.xml?a=1&b={k}" if k % 5 == 0 else f"{origin}/map{k}.xml" for k in range(25)]
        if s == 11:
            continue  # nothing answers
        bodies[f"{origin}/robots.txt"] = "User-agent: *\n" + "".join(f"Sitemap: {u}\n" for u in rng.sample(maps, rng.randrange(5)))
        for u in maps:
            if rng.random() < 0.1:
                continue
            if rng.random() < 0.5:  # any other, itself too, and other sites
                bodies[u] = xml("index", [*rng.sample(maps, rng.randrange(1, 5)), "https://elsewhere.org/x.xml"])
            else:
                bodies[u] = xml("urls", [(f"{origin}/p{rng.randrange(60)}", rng.choice(["2024-01-05", "2023-02-03", None])) for _ in range(6)])
    table, answers = spark.createDataFrame(sites, "site int, origin string"), spark.createDataFrame(list(bodies.items()), "url string, text string")
    for fetches, depth, children in ((100, 3, 50), (7, 3, 50), (40, 2, 2), (0, 3, 50)):
        ranked, fetched = discovery.sitemap_tree(table, answers, lambda df: df.cache(), fetches, depth, children)
        got, pages = {}, {}
        for r in fetched.orderBy("site", "fetch").collect():
            got.setdefault(r.site, []).append((r.url, r.depth))
        for r in ranked.orderBy("site", "position").collect():
            pages.setdefault(r.site, []).append(r["loc"])
        for s, origin in sites:
            want, found = by_queue(origin, bodies, fetches, depth, children)
            assert got.get(s, []) == want, (s, fetches)
            assert set(pages.get(s, [])) == found and len(pages.get(s, [])) == len(found)


def test_newest_first(spark):
    bodies = [("https://a.org/robots.txt", "Sitemap: https://a.org/i.xml"), ("https://a.org/i.xml", xml("index", ["https://a.org/1.xml", "https://a.org/2.xml"])), ("https://a.org/1.xml", xml("urls", [("https://a.org/old", "2020-01-01"), ("https://a.org/undated", None)])), ("https://a.org/2.xml", xml("urls", [("https://a.org/new", "2024-01-01"), ("https://a.org/old", "2023-01-01")]))]
    ranked, _ = discovery.sitemap_tree(spark.createDataFrame([("a", "https://a.org")], "site string, origin string"), spark.createDataFrame(bodies, "url string, text string"), lambda df: df.cache())
    assert [(r["loc"], r.position) for r in ranked.orderBy("position").collect()] == [("https://a.org/new", 1), ("https://a.org/old", 2), ("https://a.org/undated", 3)]


def test_navigation(spark):
    page = '<body><nav><a href="/a?x=1#y">A</a><a href="#top">t</a><a href="mailto:x@y">m</a><a href="/style.css">s</a></nav><div class="my-sidebar-left"><ul><li><a href="b">B</a></ul></div><main><a href="/c">C</a></main><a href="/a">A</a></body>'
    df = spark.createDataFrame([(1, "https://e.org/d/index#top", page)], "page_id int, url string, html string")
    out = discovery.navigation_links(elements.elements(df), df.selectExpr("page_id as page", "url"))
    assert {r.url for r in out.collect()} == {"https://e.org/a", "https://e.org/d/b", "https://e.org/d/index"}


def test_all_entries_of_large_sitemaps(spark):
    """Without a limit a map of more than MOST_URLS entries counts whole."""
    n = discovery.MOST_URLS + 10
    entries = "".join(f"<url><loc>https://a.org/{k}</loc></url>" for k in range(n))
    bodies = spark.createDataFrame([("https://a.org/robots.txt", "Sitemap: https://a.org/s.xml"), ("https://a.org/s.xml", f"<urlset>{entries}</urlset>")], "url string, text string")
    sites = spark.createDataFrame([("a", "https://a.org")], "site string, origin string")
    assert discovery.sitemap_tree(sites, bodies, stored, most=None)[0].count() == n
    assert discovery.sitemap_tree(sites, bodies, stored)[0].count() == discovery.MOST_URLS
