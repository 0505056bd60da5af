import json

from lexiforge.operators.verticals import render_answers


def test_records(spark):
    body = {"description": "A tool", "dist-tags": {"latest": "1.2.3"}, "license": None, "keywords": [f"k{i}" for i in range(32)]}
    rows = [("https://www.npmjs.com/package/@a/b", json.dumps(body)), ("https://pypi.org/project/x/", "not json"), ("https://other.org", "{}")]
    out = {r.vertical: r for r in render_answers(spark.createDataFrame(rows, "url string, body string")).collect()}
    assert set(out) == {"npm", "pypi"} and out["npm"].key == "@a/b"
    assert out["npm"].markdown.splitlines() == ["# @a/b", "", "- **Description:** A tool", "- **Latest:** 1.2.3", "- **Keywords:** " + ", ".join(f"k{i}" for i in range(30)) + " … and 2 more"]
    assert out["pypi"].markdown == "# x\n"
