import random
import re

from lexiforge.operators import logs


def step_of(line):
    return line[: line.index("\t")] if line.find("\t") > 0 else None


def first_section(lines, step):
    start = next(i for i, x in enumerate(lines) if step_of(x) == step)
    end = next((i for i in range(start + 1, len(lines)) if step_of(lines[i]) and step_of(lines[i]) != step), len(lines))
    return lines[start:end]


def excerpt(lines, most=3000):
    bad = [x for x in lines if re.search("error|fail|exception|traceback|panic|undefined", x, re.I)]
    text = "\n".join(bad[-15:] if bad else lines[-50:])
    return text if len(text) <= most else text[:most] + "\n… (truncated)"


def made(rng):
    lines = []
    for _ in range(rng.randrange(1, 120)):
        kind = rng.random()
        words = rng.choice(["all is well", "an Error here", "test FAILED", "", "a\ttab", "x" * 200])
        if kind < 0.1:
            lines.append(f"##[group]Run{rng.randrange(4)} now")
        elif kind < 0.7:
            lines.append(f"{rng.choice(['build', 'test', 'deploy'])}\tok\t12:00\t{words}")
        else:
            lines.append(words if "\t" not in words else "\t" + words)
    return lines


def test_sections_and_excerpts(spark):
    rng = random.Random(31)
    texts = {k: made(rng) for k in range(40)}
    texts[40] = ["nothing"] * 80
    texts[41] = ["error " + "y" * 400] * 20
    df = spark.createDataFrame([(k, "\n".join(t)) for k, t in texts.items()] + [(99, None)], "log_id int, text string")
    lines = logs.log_lines(df)
    got = {}
    for r in logs.step_sections(lines).orderBy("log", "section", "line").collect():
        got.setdefault((r.log, r.section, r.name), []).append(r.words)
    want = {}
    for k, t in texts.items():
        names = list(dict.fromkeys(s for s in map(step_of, t) if s))
        for i, name in enumerate(names, 1):
            want[k, i, name] = first_section(t, name)
    assert got == want
    out = {(r.log, r.section): r.excerpt for r in logs.excerpts(logs.step_sections(lines)).collect()}
    assert out == {(k, i): excerpt(v) for (k, i, _), v in want.items()}
    whole = {r.log: (r.excerpt, r.errors) for r in logs.excerpts(logs.whole_logs(lines)).collect()}
    assert {k: v[0] for k, v in whole.items() if k != 99} == {k: excerpt(t) for k, t in texts.items()}
    assert whole[41][1] == 20 and whole[41][0].endswith("(truncated)") and whole[40][0].count("nothing") == 50

    groups = {}
    for r in logs.group_sections(lines).orderBy("log", "section", "line").collect():
        groups.setdefault((r.log, r.section), []).append(r.words)
    for k, t in texts.items():
        at = [i for i, x in enumerate(t) if re.match(r"##\[group\](.+?)(?:\s|$)", x)]
        for n, (a, b) in enumerate(zip(at, [*at[1:], len(t)]), 1):
            assert groups.pop((k, n)) == t[a:b]
    assert not groups


def test_nested(spark):
    text = "a\tx\n##[group]One\na\ty\na\tz\n##[group]Two\nb\tq\n##[group]Three\nb\tr"
    out = logs.nested_sections(logs.log_lines(spark.createDataFrame([(1, text)], "log_id int, text string"))).orderBy("group_section").collect()
    assert [tuple(r) for r in out] == [(1, 1, "a", 1, 1, 3), (1, 1, "a", 2, 4, 4), (1, 2, "b", 3, 6, 7)]
