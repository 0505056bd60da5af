"""Operators against brute force, on texts with repeats, ties, nulls and odd bytes."""

import hashlib
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from lexiforge.llm import common, line_dedup, minhash, substring_dedup, suffix_dedup
from lexiforge.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed, n=40):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(12)] + ["été", "日本", "the", "The"]
    some = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = some(30)
    out = [None, "", " \n\t", "a", "aaaa" * 40, "aaaa" * 40, passage, passage]
    while len(out) < n:
        t = some(rng.randint(1, 60))
        kind = rng.random()
        if kind < 0.3:
            t = t + " " + passage + "\n" + some(3)
        elif kind < 0.5 and len(out) > 10:
            w = (rng.choice(out[8:]) or "x").split(" ")
            w[rng.randrange(len(w))] = "edit"
            t = " ".join(w)
        out.append(t)
    return [(None if rng.random() < 0.02 else i, t) for i, t in enumerate(out)]


def brute_bytes(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(x[p : p + length] for _, x in data for p in range(len(x) - length + 1))
    out = []
    for i, x in data:
        gone = [False] * len(x)
        for p in range(len(x) - length + 1):
            if count[x[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "widths"), [(1, (8, 2, 1)), (2, (16, 4, 1)), (3, (1,))])
def test_suffix_dedup(documents, seed, widths):
    rows = texts(seed)
    out = suffix_dedup.dedup_strings(documents(rows), length=40, piece=8, widths=widths)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(brute_bytes(rows, 40), key=repr)


def brute_words(rows, n):
    first, split = {}, [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - n + 1):
            if i is not None:
                k = tuple(w[p : p + n])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if i is not None and first[tuple(w[p : p + n])] < i:
                gone[p : p + n] = [True] * n
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def test_suffix_dedup_at_the_default_length(documents):
    """Passages of 399, 400 and 401 bytes, runs of one letter, a copy inside the same document, multi-byte characters."""
    rng = random.Random(11)
    noise = lambda k: "".join(rng.choice("abcdefghij klmnop") for _ in range(k))
    p = noise(401)
    rows = [(0, noise(50) + p[:399] + "X"), (1, p[:400] + noise(90)), (2, noise(700) + p), (3, "z" * 1500), (4, "z" * 420), (5, "y" + "z" * 398)]
    rows += [(6, "é" * 300 + noise(20)), (7, "a" + "é" * 205), (8, noise(600)), (9, None), (10, "")]
    block = noise(450)
    rows += [(11, block + noise(30) + block), (12, noise(5000)), (13, rows[8][1]), (13, rows[8][1])]
    out = suffix_dedup.dedup_strings(documents(rows))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(brute_bytes(rows, 400), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(documents, seed):
    rows = texts(seed)
    out = substring_dedup.dedup_substrings(documents(rows), length=8, piece=3)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(brute_words(rows, 8), key=repr)


def shingles(text):
    w = WORDS.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    label = {i: i for i, _ in rows}
    sets = {i: shingles(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in label:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def near_copies(seed):
    """A hot group whose copies differ in few to many words, some pairs above and some below the threshold; a chain; plain copies."""
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(400)]
    base = [rng.choice(vocab) for _ in range(80)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    chain = list(base[::-1])
    for k in range(8):
        chain = chain[: len(chain) - 4] + [f"c{k}{j}" for j in range(2)]
        rows.append(" ".join(chain))
    rows += [rows[0]] * 5 + [rows[0].upper(), "one two", "ONE  two", "", None, " \t"]
    rows += [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(20)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "blocks"), [(1, (256, 2048)), (2, (4, 8))])
def test_near_duplicates(documents, monkeypatch, seed, blocks):
    monkeypatch.setattr(minhash, "ASKED_BLOCK", blocks[0])
    monkeypatch.setattr(minhash, "OTHERS_BLOCK", blocks[1])
    rows = near_copies(seed)
    out = minhash.near_duplicates(documents(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute_components(rows)
    kept = minhash.drop_near_duplicates(documents(rows)).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in out if r.kept} and kept[0].row_key == 1


@pytest.mark.parametrize("kind", ["path", "shuffled path", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(2)
    order = list(range(60))
    if kind != "path":
        rng.shuffle(order)
    edges = {"none": [], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(70)]}.get(kind, list(zip(order, order[1:])))
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.node, r.label) for r in got) == sorted(label.items())


def brute_lines(rows, n, least_chars=200):
    lines = [(i, t.split("\n") if t else []) for i, t in rows]
    full = [(i, [(k, x) for k, x in enumerate(ls) if x.strip(" \t\r")]) for i, ls in lines]
    sizes = {n} | {1 << k for k in range(n) if 1 << k < n}
    first = {}
    for d, (i, ls) in enumerate(full):
        for size in sizes:
            for p in range(len(ls) - size + 1):
                first.setdefault(tuple(x for _, x in ls[p : p + size]), (d, p))
    out = []
    for d, (i, ls) in enumerate(full):
        gone = set()
        for size in sizes:
            for p in range(len(ls) - size + 1):
                run = tuple(x for _, x in ls[p : p + size])
                if first[run] != (d, p) and (size == n or sum(map(len, run)) >= least_chars):
                    gone |= set(range(p, p + size))
        runs = sum(q - 1 not in gone for q in gone)
        out_lines = {ls[q][0] for q in gone}
        out.append((i, len(lines[d][1]), len(gone), runs, "\n".join(x for k, x in enumerate(lines[d][1]) if k not in out_lines)))
    return out


def test_line_dedup_of_one_and_two_long_lines(documents):
    long, half, other = "é" * 200, "h " * 50, "o " * 50
    rows = [(0, f"{long}\na"), (1, f"b\n{long}"), (2, long), (3, f"{half}\n{other}\nc"), (4, f"d\n{half}\n\n{other}"), (5, half), (6, long[1:])]
    out = sorted((r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.kept_text) for r in line_dedup.dedup_lines(documents(rows)).collect())
    assert out == sorted(brute_lines(rows, 3)) and [r[2] for r in out] == [0, 1, 1, 0, 2, 0, 0]


def test_line_dedup(documents):
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "a\nb\n\nc\nd"), (4, "x\na\nb\nc\nd\ny"), (5, "a\nb\nc\na\nb\nc\na\nb\nc"), (6, "z" * 10)]
    rows += [(7 + k, "\n".join(rng.choice(["a", "b", "c", "d", "", " ", "é"]) for _ in range(rng.randint(1, 25)))) for k in range(25)]
    for n in (2, 3, 5):
        out = [(r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.kept_text) for r in line_dedup.dedup_lines(documents(rows), n).collect()]
        assert sorted(out) == sorted(brute_lines(rows, n))


def test_empty_tables(documents):
    none = documents([])
    assert suffix_dedup.dedup_strings(none).count() == 0
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0


def test_runs_are_longest_common_prefixes(documents):
    """Long runs, runs that overlap themselves, and copies of copies: each run's length against plain comparison."""
    rng = random.Random(12)
    block = [f"block line {k}" for k in range(40)]
    rows = [(k, "\n".join(rng.choices("abc", k=rng.randrange(25)))) for k in range(25)]
    rows += [(100 + k, "\n".join([f"own {k}", *block[rng.randrange(10) : 20 + rng.randrange(20)], "", f"end {k}", *rng.choices("abc", k=4)])) for k in range(12)]
    rows += [(200, "\n".join(["z"] * 37)), (201, "\n".join(["z"] * 50)), (202, "\n".join(block * 2))]
    docs = common.keyed(documents(rows))
    lines = {(r.row_key, r.doc_id): [x for x in r.text.split("\n") if x.strip()] for r in docs.collect()}
    split = docs.select("row_key", "doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("i", "words"))
    positions = common.materialize(split.select("row_key", "doc_id", F.col("i").alias("line"), "i", F.xxhash64("words").alias("id"), F.xxhash64(F.lit(1), "words").alias("id2"), F.length("words").alias("chars")), "test-lines")
    for least in (3, 5):
        runs = line_dedup.repeated_runs(line_dedup.ranks(positions, least), least).collect()
        assert runs and max(r.n for r in runs) >= 30
        for r in runs:
            a, b = lines[r.row_key, r.doc_id][r.i :], lines[r.of.row_key, r.of.doc_id][r.of.i :]
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert r.n == same >= least and (r.of.doc_id, r.of.i) < (r.doc_id, r.i)
