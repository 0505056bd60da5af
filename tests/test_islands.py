import json
import random

from pyspark.sql import functions as F

from lexiforge.operators import elements, islands


def rows(spark, *pages):
    return elements.elements(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"))


STATE = {"user": {"name": "Ann } \" {", "tags": ["a", "b"]}, "n": 3, "deep": {"a": {"b": {"c": {"d": 1}}}}, "none": None, "empty": {}}


def test_sources(spark):
    page = f"""<html><script type="application/ld+json">{json.dumps({"@type": "Thing", "text": "words"})}</script>
<script id="my-App-Data">{json.dumps([1, 2])}</script><script type="application/json">not json</script>
<script>var x = 1; window.__INITIAL_STATE__ = {json.dumps(STATE)}; const __NUXT__={{"k":[{{"z":1}}]}}
window.__DATA__ = {{broken: 1}}; window.__sveltekit_1abc = {{"s": "t"}}; window.__DATA__ = {{"later": true}}; let __store = {{"open": 1</script>
<script>self.__next_f.push([1,"2:[\\"$\\",\\"p\\",null,{{\\"children\\":\\"A sentence that is long enough to be read by people.\\"}}]"])</script></html>"""
    found = {r.source: r.json for r in islands.islands(rows(spark, page, "<p>none</p>", None)).collect()}
    assert set(found) == {'script[type="application/ld+json"]', "my-App-Data", "__INITIAL_STATE__", "__NUXT__", "__DATA__", "__sveltekit_", islands.STREAMED}
    assert json.loads(found["__INITIAL_STATE__"]) == STATE and json.loads(found["__DATA__"]) == {"later": True}
    assert "A sentence that is long enough" in found[islands.STREAMED]


def flat(value, path="$", depth=0, most=3):
    if isinstance(value, dict | list) and value and depth <= most:
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from flat(v, path + (f".{k}" if isinstance(value, dict) else f"[{k}]"), depth + 1, most)
    else:
        yield path, depth, None if value is None else json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False) if isinstance(value, dict | list | bool) else str(value)


def made(rng, depth=0):
    kind = rng.random()
    if depth < 6 and kind < 0.3:
        return {rng.choice("abcdef"): made(rng, depth + 1) for _ in range(rng.randrange(4))}
    if depth < 6 and kind < 0.5:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([1, -5, "text", "é } {", True, None, ""])


def test_leaves_by_recursion(spark):
    rng = random.Random(41)
    values = [{"v": made(rng)} for _ in range(60)] + [[1, [2]], {}, []]
    df = spark.createDataFrame([(k, "s", json.dumps(v)) for k, v in enumerate(values)], "page int, source string, json string")
    for most in (1, 3):
        got = sorted((r.page, r.path, r.depth, r.value) for r in islands.leaves(df, most).collect())
        want = sorted((k, *x) for k, v in enumerate(values) for x in flat(v, most=most))
        assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]


def test_best_and_markdown(spark):
    text, large = {"title": "T" * 50, "body": ["p" * 100, "q" * 100]}, {f"k{i}": i for i in range(60)}
    page = f'<script id=app-data>{json.dumps(large)}</script><script id=page-props>{json.dumps(text)}</script>'
    best = islands.best_island(islands.islands(rows(spark, page))).withColumn("markdown", islands.json_markdown("json")).first()
    assert best.source == "page-props" and best.score == 2 * 250 + len(json.dumps(text))
    assert best.markdown == f"**title:** {'T' * 50}\n**body:**\n  - {'p' * 100}\n  - {'q' * 100}"
    assert islands.shown(STATE) == '**user:**\n  **name:** Ann } " {\n  **tags:**\n    - a\n    - b\n**n:** 3\n**deep:** **a:** **b:** **c:** `{object}`\n**none:** `null`\n**empty:** '
    assert islands.shown(list(range(60))).endswith("- 49\n- _… and 10 more_") and islands.shown([[[[[1, 2]]]]]) == "- - - - `[array ×2]`"
