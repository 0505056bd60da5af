import random
import re

import pytest

from lexiforge.operators import budget, markdown, sections

HEADING = re.compile(r"[ \t]{0,3}#{1,6}[ \t]+(.*?)[ \t]*$")


def prose_of(text):
    """(heading, words) of each line of prose, headings and fences as the grammar has them."""
    lines, heading, out = text.split("\n"), None, []
    for line, (inside, _, acts) in zip(lines, markdown.fence_states(lines), strict=True):
        if not inside and HEADING.match(line):
            heading = HEADING.match(line)[1]
        elif not acts and line.split():
            out.append((heading, line.split()))
    return out


def body_of(text):
    m = re.match(r"(?s)\A---[ \t]*\r?\n(.*?\r?\n)?---[ \t]*(?:\r?\n|\Z)", text)
    return text[m.end() :] if m else text


def check(source, most, out):
    """The ceiling, prose, and no wrong heading."""
    assert sections.cost(out) <= most, (source, most, out)
    if sections.cost(source) <= most:
        assert out == source
        return
    source = source.replace("\r", "")
    body = body_of(source)
    front = source[: len(source) - len(body)]
    out = out.removeprefix(front)
    own = prose_of(body)
    usable = [(h, w) for h, w in own if any(not re.fullmatch(r"#+|[`~]{3,}.*", x) for x in w)]
    shown = prose_of(re.sub(r"\n\n(---\n)?\*(Cut to|\d+ of)(.|\n)*\Z", "", out))
    if usable:
        assert shown, (source, most, out)
    for heading, found in shown:
        text = " ".join(found)
        places = [h for h, w in own if text in " ".join(w)]
        assert places, (source, most, out, text)
        assert heading in places or heading is None, (source, most, out, text)
    states = list(markdown.fence_states(out.split("\n")))
    assert not states[-1][1], ("an open fence", source, most, out)


def run(spark, rows, most, **more):
    df = spark.createDataFrame([(i, t, "https://example.org/page") for i, t in rows], "doc_id long, text string, url string")
    return {r.doc_id: r for r in budget.fit(df, most, url_col="url", **more).collect()}


WORDS = ["word", "a", "considerable", "$x=1;", "{}{}{}", "日本語", "https://e.org/x?y=1", "#", "##", "internationalisation" * 3, "end."]
MARKS = ["```", "````", "~~~", "```py", "# A", "## B b", "### C", "", "  ", "    code", "---", "| a | b |"]


def document(rng):
    """Lines of few words and of marks in any order, maybe below a front matter."""
    lines = [rng.choice(MARKS) if rng.random() < 0.5 else " ".join(rng.choices(WORDS, k=rng.randrange(12))) for _ in range(rng.randrange(30))]
    return "---\nurl: https://example.org/a\ntitle: words of a title\n---\n" * rng.randrange(2) + "\n".join(lines)


@pytest.mark.parametrize("query", [None, "considerable word"])
@pytest.mark.parametrize("most", [1, 2, 3, 4, 6, 11, 23, 40])
def test_properties(spark, most, query):
    rng = random.Random(most)
    texts = [document(rng) for _ in range(400)]
    out = run(spark, enumerate(texts), most, query=query)
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        check(t, most, out[i].text)
        assert out[i].tokens == sections.cost(out[i].text)


PAGE = "---\nurl: https://e.org\n---\n# Title\n\nOpening words of the page.\n\n## First\n\n" + "alpha beta gamma. " * 20 + "\n\n## Second\n\n```py\n# no heading\ncode line one\ncode line two\n```\n\nafter the code\n\n## Third\n\nomega words about pelicans. " * 3


def test_every_budget_of_a_page(spark):
    rows = []
    for most in [*range(1, 30, 4), *range(30, 181, 25)]:
        rows.append(run(spark, [(1, PAGE)], most)[1])
        check(PAGE, most, rows[-1].text)
    assert rows[-1].text == PAGE
    cut = rows[-2].text
    assert cut.startswith("---\nurl") and "*Omitted sections:*\n  - Third" in cut and "https://example.org/page" in cut


@pytest.mark.parametrize("most", [1, 7, 50, 200])
def test_all_documents(spark, most):
    from lexiforge.plans import cases

    docs = cases._structured(spark, "/root/testdata/sf0.001")
    out = {r.doc_id: r.text for r in budget.fit(docs, most).collect()}
    assert len(out) == docs.count()
    for r in docs.collect():
        check(r.text, most, out[r.doc_id])


def test_query_chooses_sections(spark):
    text = "# One\n\n" + "filler words here. " * 30 + "\n\n# Two\n\npelicans and herons\n\n# Three\n\n" + "more of filler. " * 30
    plain, asked = run(spark, [(1, text)], 40)[1], run(spark, [(1, text)], 40, query="pelicans")[1]
    assert "# One" in plain.text and "pelicans" not in plain.text
    assert "# Two\n\npelicans and herons" in asked.text and asked.n_sections == 3 and asked.n_omitted <= 2


def test_section_scores(spark):
    body = "words " * 50
    df = spark.createDataFrame([(1, f"lead\n# Price overview\n{body}\n## Code\n```\nx\n```\n### Deep\nsummary")], "doc_id long, text string")
    got = {r.section: r.score for r in budget.section_scores(df).collect()}
    assert got == {0: 3.0, 1: 6 + 2 + 2 * 2, 2: 5 - 1.0, 3: 4 + 0.5}
    both = {r.section: r.score for r in budget.section_scores(df, "summary", combine=True).collect()}
    only = {r.section: r.score for r in budget.section_scores(df, "summary").collect()}
    assert only[3] > 0 and only[1] == 0 and all(both[k] == pytest.approx(0.7 * only[k] + 0.3 * got[k]) for k in got)


def test_long_and_empty(spark):
    rng = random.Random(3)
    long = "\n".join(" ".join(f"w{rng.randrange(999)}" for _ in range(50)) for _ in range(4000))
    out = run(spark, [(1, long), (2, None), (3, ""), (4, "x" * 100_000), (5, "```\nonly code here\n```"), (6, "# " + "Heading " * 50 + "\n\nprose")], 20)
    for k, t in ((1, long), (4, "x" * 100_000), (6, "# " + "Heading " * 50 + "\n\nprose")):
        check(t, 20, out[k].text)
    assert out[2].text == out[3].text == "" and out[4].text.startswith("xxx") and out[5].text == "```\nonly code here\n```" and out[6].text.startswith("prose")
