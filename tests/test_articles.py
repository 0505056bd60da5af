import re

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import articles

PROSE = "This paragraph has several words, some commas, and enough letters to count as a block of text. "


def extract(spark, *pages):
    df = spark.createDataFrame([(k, "https://e.org/a/b", h) for k, h in enumerate(pages)], "page_id int, url string, html string")
    return {r.page_id: r for r in articles.extract(df).collect()}


def test_structure(spark):
    page = f"""<html><head><title>T</title></head><body><div id=content>
<h1>Head &amp; line</h1><p>{PROSE * 3}<br>after a break, <code>x = 1</code> and <a href="../c?x=1">a link</a>.</p>
<ul><li>one<ul><li>inner a</li><li>inner b</li></ul></li><li>two</li></ul>
<ol><li>first</li><li><p>second</p></li></ol>
<blockquote><p>Quoted words</p></blockquote>
<pre><code class="language-py">def f():
    return "```"
</code></pre>
<table><thead><tr><th>A</th><th>B|b</th></tr></thead><tbody><tr><td>1</td><td>two
lines</td></tr><tr><td>only</td></tr></tbody></table>
<h2>End</h2><p>{PROSE * 2}</p></div></body></html>"""
    out = extract(spark, page)[0]
    assert out.chosen_by == "score" and out.title == "T"
    parts = out.markdown.split("\n\n")
    assert parts[0] == "# Head & line"
    assert parts[1].endswith("\nafter a break, `x = 1` and [a link](https://e.org/c?x=1).")
    assert parts[2] == "- one\n  - inner a\n  - inner b\n- two\n1. first\n2. second"
    assert parts[3] == "> Quoted words"
    assert parts[4] == '````py\ndef f():\n    return "```"\n````'
    assert parts[5] == "| A | B\\|b |\n| --- | --- |\n| 1 | two lines |\n| only |  |"
    assert parts[6] == "## End" and len(parts) == 8


@pytest.mark.parametrize("selector", ["#onetrust-banner-sdk", ".klaro", "[class*=cookie-banner]", "[id*=gdpr-banner]", "[role=dialog]", "[data-cmp]", "footer", "[aria-hidden=true]"])
def test_noise(spark, selector):
    attribute = re.fullmatch(r"\[([\w-]+)(?:\*?=(.*))?\]", selector)
    name, value = attribute.groups() if attribute else ({"#": "id", ".": "class"}.get(selector[0]), selector[1:])
    tag = selector if name is None else "div"
    mark = "" if name is None else f' {name}="{"x " if name == "class" else ""}{value or ""}{"-y" if "*" in selector else ""}"'
    noise = f"<{tag}{mark}><p>We value your privacy, and so on, and so on, in many words. {PROSE * 6}</p></{tag}>"
    page = f"<body><main>{noise}<p>{PROSE * 4}</p><p>{PROSE}</p></main></body>"
    out = extract(spark, page)[0]
    assert "privacy" not in out.markdown and out.markdown.count("several words") == 5


def test_fallbacks(spark):
    short = "<body><div>menu</div><main>Short main text</main></body>"
    tiny = f"<body><article><p>{PROSE * 3}</p></article><script>{'x' * 200_000}</script></body>"
    links = "<body><ul>" + "".join(f"<li><a href=/{k}>Link with quite some words in it, number {k}</a></li>" for k in range(40)) + f"</ul><div><p>{PROSE * 3}</p></div></body>"
    out = extract(spark, short, tiny, links, "no markup at all", None, "", "<html><body><nav>only</nav></body></html>")
    assert (out[0].chosen_by, out[0].markdown) == ("main", "Short main text")
    assert out[1].chosen_by == "main" and out[1].markdown == PROSE.strip() + (" " + PROSE.strip()) * 2
    assert out[2].chosen_by == "score" and out[2].markdown.startswith("This paragraph") and "Link" not in out[2].markdown
    assert [out[k].markdown for k in (3, 4, 5, 6)] == ["", "", "", ""] and len(out) == 7


def test_boilerplate_planted_in_real_pages(spark):
    """Consent dialogs, sidebars, related links and comments go; of the article's words all stay."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    front = '<div class="cookie-consent"><p>boilerplateone we use cookies, many of them, for many purposes, and so on.</p></div><div class="sidebar"><p>boilerplatetwo subscribe now, and again, and again, to our letters.</p></div>'
    back = '<section class="related"><ul><li><a href="/x">boilerplatethree read also this long headline, and that</a></li></ul></section><div id="comments"><p>boilerplatefour first comment, with some words, and more.</p></div>'
    planted = pages.select("page_id", "url", F.concat(F.replace(F.replace("html", F.lit("<article>"), F.lit(front + "<article>")), F.lit("</article>"), F.lit("</article>" + back))).alias("html"))
    before = {r.page_id: r.markdown for r in articles.extract(pages).collect()}
    after = {r.page_id: r for r in articles.extract(planted).collect()}
    long = [k for k, m in before.items() if len(m) >= 300]
    assert len(long) >= 0.6 * len(before)
    kept = sum(after[k].markdown == before[k] for k in long)
    clean = sum("boilerplate" not in r.markdown for r in after.values())
    assert kept == len(long) and clean == len(after), (kept, len(long), clean, len(after))
