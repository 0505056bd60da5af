import random

from pyspark.sql import functions as F

from lexiforge.operators import envelopes, markdown, previews, sections


def test_previews_show_the_section_worth_most(spark):
    links = "https://x.org " * 300
    texts = [
        ("---\nurl: u\n---\n# A\nfew words here\n## References\n" + "word " * 900 + "\n# B\n" + links + "\n# C\n" + "good " * 700, "C", "good " * 360 + "…"),
        ("# See also\n" + "word " * 700 + "\n# Notes\n" + links, "See also", "word " * 360 + "…"),
        ("flat text without any heading, " * 300, None, None),
        ("My Title\n\n" + "It is a sentence. " * 400, None, None),
        ("# Short\nwords", 0, 0),
        (None, 0, 0),
    ]
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in previews.frugal_previews(docs).collect()}
    assert {k: (r.heading, r.excerpt) for k, r in found.items()} == {k: (h, e) for k, (_, h, e) in enumerate(texts) if h != 0}
    assert found[0].outline.split("\n") == ["Outline: 1907 words, 4 sections", "- A (3)", "  - References (900)", "- B (300)", "- C (700)"]
    assert found[2].outline == "Outline: 1500 words\n- (no headings — flat document)"
    assert found[3].outline == "Outline: 1602 words, 1 section\n  - My Title (1600)"
    assert previews.frugal_previews(docs.limit(0)).count() == 0


def test_style_sheets_go_once(spark):
    rng = random.Random(3)
    lines = ["a", ".x { top: 0 }", "@media x {", "}", "<style>", "</style>", "```", "~~~", "{", "@layer a { b: c } }"]
    for _ in range(500):
        text = "\n".join(rng.choices(lines, k=rng.randint(0, 12)))
        once = markdown.unstyled(text)
        left = iter(text.split("\n"))
        assert all(x in left for x in once.split("\n") if once)
        if "```" not in text and "~~~" not in text:
            assert markdown.unstyled(once) == once and ".x" not in once


def test_fields_are_masked_whatever_they_hold():
    assert envelopes.scrub("api-key = [1, {'a': ']'}], b") == "api-key = [redacted-credential], b"
    assert envelopes.scrub("token: {never closed") == "token: [redacted-credential]"
    assert envelopes.scrub("CDP_target_id=7;lease:x") == "CDP_target_id=[redacted-id];lease:[redacted-id]"
    assert envelopes.scrub_value({"a": [{"Session-Token": [1]}, 2.5], "b": None}) == {"a": [{"Session-Token": "[redacted-credential]"}, 2.5], "b": None}
    long = "token: " + "[" * 200_000
    assert envelopes.scrub(long) == "token: [redacted-credential]"
    assert envelopes.scrub("plain words " * 100_000) == "plain words " * 100_000


def test_wrappers_go(spark):
    text = "---\nurl: x\n---\n [UNTRUSTED WEB CONTENT START]\nbody\n[UNTRUSTED WEB CONTENT END] \nend"
    assert spark.range(1).select(sections.without_wrapper(F.lit(text))).first()[0] == "body\nend"
