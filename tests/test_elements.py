import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiforge.operators import articles, decisions, elements

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a = "<p>";</script></head>
<body><nav><a href="/x">Home</a></nav>
<main id="m" class="wide"><h1>Title</h1><p>One <a href="/1">first link</a> and <b>bold</b><p>Two
<ul><li>a<li>b <a href="/2">second</a></ul><img src="i.png" alt="pic"><br/>
<form action="/s"><input type="text" placeholder=" Search "><input type=hidden name=h value=1><input type="submit" value="Go">
<select name=s><option value="1">One<option>Two<option value=""></select><textarea disabled></textarea><button hidden>no</button></form>
<div role="button" onclick="f()" aria-label="Menu">x</div><a href="/1">first link</a><a>no target</a><span onclick="g()"></span></main>
<footer><button>Imprint</button></footer></body></html>"""


def random_page(rng, depth=0):
    """Well-formed markup, and what its elements hold, by recursion."""
    out, text = "", ""
    found = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.random()
        if kind < 0.4 or depth > 4:
            t = rng.choice(["word", " two words ", "é日", "\n"])
            out, text = out + t, text + t
        elif kind < 0.5:
            out += "<img>"
            found.append({"tag": "img", "text": "", "inside": 0, "children": [], "attrs": {}})
        else:
            tag = rng.choice(["div", "a", "span", "section"])
            attrs = {"class": "c"} if rng.random() < 0.5 else {}
            inner, inner_text, kids = random_page(rng, depth + 1)
            out += f"<{tag}{''.join(f' {k}={chr(34)}{v}{chr(34)}' for k, v in attrs.items())}>{inner}</{tag}>"
            text += inner_text
            found.append({"tag": tag, "text": inner_text, "inside": len(inner), "children": kids, "attrs": attrs})
    return out, text, found


def flat(kids, path):
    """In order of opening tags: tag path, text, source inside, text of links below, children by tag, place among equal siblings."""
    rows = []
    for k, e in enumerate(kids):
        same = [i for i, x in enumerate(kids) if x["tag"] == e["tag"]]
        below = flat(e["children"], [*path, e["tag"]])
        linked = sum(len(r["text"]) for r in below if r["path"][-1] == "a")
        counts = {}
        for c in e["children"]:
            counts[c["tag"]] = counts.get(c["tag"], 0) + 1
        rows.append({"path": [*path, e["tag"]], "text": e["text"], "inside": e["inside"], "linked": linked, "children": counts, "index": same.index(k), "count": len(same), "attrs": e["attrs"]})
        rows += below
    return rows


def test_marks_against_a_tree_by_recursion(spark):
    rng = random.Random(8)
    pages, want = [], {}
    for k in range(40):
        inner, text, kids = random_page(rng)
        pages.append((k, f"<html>{inner}</html>"))
        for place, r in enumerate(flat([{"tag": "html", "text": text, "inside": len(inner), "children": kids, "attrs": {}}], [])):
            want[k, place] = (r["path"], len(r["text"]) / r["inside"] if r["inside"] else 0, min(1, r["linked"] / len(r["text"])) if r["text"] else 0, r["children"], r["attrs"], r["index"], r["count"])
    rows = elements.elements(spark.createDataFrame(pages, "page_id int, html string"))
    got = {(r.page, r.place): tuple(r.mark) for r in elements.marks(rows).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k] == pytest.approx(w) if not isinstance(w[0], list) else (got[k][0], got[k][3:]) == (w[0], w[3:]) and got[k][1:3] == pytest.approx(w[1:3]), (k, got[k], w)


def test_tree_of_untidy_markup():
    page = elements.parse(PAGE)
    by = {}
    for e in page["elements"]:
        by.setdefault(e["tag"], []).append(e)
    assert [e["address"] for e in by["p"]] == ["/html/body/main/p[1]", "/html/body/main/p[2]"]
    assert [page["text"][e["text_start"] : e["text_start"] + e["text_length"]].strip() for e in by["li"]] == ["a", "b second"]
    assert len(by["option"]) == 3 and all(e["path"][-2] == "select" for e in by["option"])
    assert by["img"][0]["last"] == by["img"][0]["place"] and "<p>" in page["text"] and by["html"][0]["last"] == len(page["elements"]) - 1
    assert elements.parse(None) == {"text": "", "elements": []} and elements.parse("a <b") ["elements"] == []


def test_actions(spark):
    rows = elements.elements(spark.createDataFrame([(1, PAGE), (2, None), (3, "<a href=x>" + "</a><a href=x>y" * 3)], "page_id int, html string"))
    out = elements.actions(rows).orderBy("page", "ref").collect()
    got = [(r.role, r.name, r.affordance, r.name_source) for r in out if r.page == 1]
    assert got == [
        ("link", "first link", "click", "text"), ("link", "second", "click", "text"), ("form", "OneTwono", "submit", "text"), ("textbox", "Search", "type", "placeholder"), ("button", "Go", "click", "value"),
        ("select", "OneTwo", "select", "text"), ("button", "Menu", "click", "aria-label"), ("span", "[span]", "click", "tag"),
    ]
    select = next(r for r in out if r.role == "select")
    assert select.options == ["1", "Two"] and [r.value for r in out if r.name == "Go"] == ["Go"]
    assert [(r.ref, r.name) for r in out if r.page == 3] == [(1, "[a]"), (2, "y")]
    assert elements.actions(rows, most=3).where("page = 1").count() == 3
    text = elements.action_lines(elements.actions(rows)).where("page = 1").first().text
    assert text.startswith("## Actions\n[1] link: first link (click)\n") and '[5] button: Go (click) value="Go"' in text and "[6] select: OneTwo (select) options=[1,Two]" in text


def test_all_actions_of_a_page(spark):
    page = "".join(f"<a href=x>link {k}</a>" for k in range(120)) + "<form><select><option>a</select></form>"
    rows = elements.elements(spark.createDataFrame([(1, page)], "page_id int, html string"))
    acts = elements.actions(rows)
    out = acts.orderBy("ref").collect()
    assert [r.ref for r in out] == list(range(1, 123)) and [r.name for r in out[:120]] == [f"link {k}" for k in range(120)] and out[-1].options == ["a"]
    assert "[122] select: a" in elements.action_lines(acts).first().text


def test_an_element_is_found_again(spark):
    """The article of a page whose markup has changed around it."""
    before = "<html><body><div class=top>menu</div><div id=main class=post><p>" + "text " * 50 + "</p><p>more</p></div></body></html>"
    after = "<html><body><header>new <div class=top>menu</div></header><section><div id=main class=post><p>" + "other text " * 60 + "</p><p>more</p></div></section></body></html>"
    rows = elements.elements(spark.createDataFrame([(1, before), (2, after)], "page_id int, html string"))
    marked = elements.marks(rows)
    old = marked.where((F.col("page") == 1) & (F.col("mark.attributes")["id"] == "main")).select(F.lit(2).alias("page"), "mark")
    found = decisions.located(old, marked.where("page = 2")).collect()
    at = {(r.page, r.place): r.attributes for r in rows.collect()}
    assert len(found) == 1 and at[2, found[0].place]["id"] == "main" and found[0].score >= 0.45


def test_a_task_holds_few_pages_at_a_time(monkeypatch):
    monkeypatch.setattr(elements, "CHUNK", 100)
    pages = ["<p>" + "x" * 60 + "</p>", None, "<p>y</p>", "<b>" + "z" * 200, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(pages)], ["page", "_html"])
    out = list(elements._parsed(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in out] == [4, 1]
    assert [r["page"] for b in out for r in b.to_pylist()] == [0, 1, 2, 3, 4]
    assert [len(r["elements"]) for b in out for r in b.to_pylist()] == [1, 0, 1, 1, 0]


def test_pages_are_parsed_once(spark):
    """Actions and articles read what was parsed from a stored table."""
    pages = spark.createDataFrame([(1, "https://e.org", "<article><p>" + "some words, " * 40 + "</p><a href=x>y</a></article>")], "page_id int, url string, html string")
    for df in (elements.actions(elements.elements(pages)), articles.extract(pages)):
        assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
