import re

from lexiforge.operators import extensions, verticals
from lexiforge.operators.extensions import Extractor, Hook

ROWS = [("https://mine.org/a", "one"), ("https://mine.org/b", "two"), ("https://pypi.org/project/x", '{"info": {"summary": "S", "version": "1"}}'), ("https://other.org/", "free"), (None, "no url"), ("https://mine.org/c", None)]


def test_failing_extractors_leave_rows_as_they_were(spark):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "id int, url string, body string")

    def fails(url, body):
        if body == "two" or "pypi" in url:
            raise RuntimeError("broken")
        return f"# Mine {body.upper()}"

    extractors = [Extractor("picky", lambda u: u.endswith("/c"), lambda u, b: None), Extractor("mine", lambda u: "mine" in u or "pypi" in u, fails), Extractor("late", lambda u: "mine" in u, lambda u, b: "late")]
    out = {r.id: r for r in extensions.extracted(df, extractors).collect()}
    assert len(out) == len(ROWS) and [out[k].body for k in range(6)] == [b for _, b in ROWS]
    assert (out[0].markdown, out[0].via, out[0].vertical, out[0].skipped) == ("# Mine ONE", "user", "mine", None)
    assert (out[1].markdown, out[1].vertical, out[1].skipped) == ("late", "late", "mine: broken")
    built = verticals.render_answers(df.where("id = 2")).first()
    assert (out[2].markdown, out[2].via, out[2].key, out[2].skipped) == (built.markdown, "built-in", "x", "mine: broken")
    assert (out[3].markdown, out[3].via, out[3].skipped) == (None, None, None)
    assert out[4].via is None and "argument" in out[4].skipped or out[4].skipped
    assert out[5].vertical == "late" and "mine: " in out[5].skipped
    # without extractors the built-in ones are all there is
    plain = {r.id: r.markdown for r in extensions.extracted(df, []).collect()}
    assert plain == {k: built.markdown if k == 2 else None for k in range(6)}


def test_extractors_from_a_folder(spark, tmp_path):
    (tmp_path / "good.py").write_text("import re\nname = 'good'\nPATTERN = re.compile('mine')\n\ndef match(url):\n    return bool(PATTERN.search(url))\n\ndef extract(url, body):\n    return helper(body)\n\ndef helper(body):\n    return f'<{body}>'\n")
    for name, text in {"noname": "def match(u): return True\ndef extract(u, b): return b", "nomatch": "name = 'x'\ndef extract(u, b): return b", "throws": "name = 'x'\ndef match(u): raise ValueError('no')\ndef extract(u, b): return b", "syntax": "name ="}.items():
        (tmp_path / f"{name}.py").write_text(text)
    found, problems = extensions.load_extractors(str(tmp_path))
    assert [e.name for e in found] == ["good"] and len(problems) == 4
    df = spark.createDataFrame(ROWS[:2], "url string, body string").repartition(2)
    assert {r.markdown for r in extensions.extracted(df, found).collect()} == {"<one>", "<two>"}
    assert extensions.load_extractors(str(tmp_path / "none")) == ([], [])


def test_hooks(spark):
    def bad(url, value):
        raise RuntimeError("broken")

    hooks = [Hook("https://mine.org/*", after_fetch=lambda u, v: v + "!"), Hook("https://**", after_fetch=bad, after_extract=lambda u, v: "x"), Hook("https://mine.org/a", after_fetch=lambda u, v: v * 2), Hook("**/b", after_fetch=lambda u, v: None)]
    df = spark.createDataFrame(ROWS, "url string, body string")
    assert [r.body for r in extensions.hooked(df, hooks, "body").collect()] == ["one!one!", "two!", ROWS[2][1], "free", "no url", None]
    assert [r.body for r in extensions.hooked(df, hooks, "body", "after_extract").collect()] == ["x", "x", "x", "x", "no url", "x"]
    assert extensions.hooked(df, [Hook("x")], "body") is df


def test_patterns():
    match = lambda p, u: bool(re.match(extensions.glob_pattern(p), u))
    assert match("https://a.org/*", "https://a.org/x") and not match("https://a.org/*", "https://a.org/x/y")
    assert match("https://a.org/**", "https://a.org/x/y") and match("**/y", "https://a.org/x/y") and not match("a.org", "aXorg")
