"""One text of several megabytes through every operator, among short ones."""

import hashlib
import random
import re
import zlib

import pytest

from lexiforge.llm import chat_format, common, decontaminate, divergence, language, lexical, line_dedup, minhash, mixing, quality, sharding, substring_dedup, suffix_dedup, warc

WORDS = 500_000


@pytest.fixture(scope="module")
def long():
    """About 4 MB of words, of which a passage stands at both ends."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(WORDS)]
    passage = [f"passage{k}" for k in range(60)]
    words[10:70] = passage
    words[-90:-30] = passage  # with line breaks at the same places
    return "\n".join(" ".join(words[k : k + 50]) for k in range(0, WORDS, 50))


@pytest.fixture(scope="module")
def docs(spark, long):
    rows = [(1, long, "en", "s"), (2, "a few words of a short text", "en", "s"), (3, " ".join(f"passage{k}" for k in range(20)), "de", "t"), (4, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_copies(spark, docs, long):
    out = {r.doc_id: r for r in suffix_dedup.dedup_strings(docs).collect()}
    # the passage, twice, with the spaces that its copies share
    assert out[1].n_bytes == len(long) and out[1].n_spans == 2 and out[1].n_removed >= 2 * len(" ".join(f"passage{k}" for k in range(60)))
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs).collect()}
    assert (out[1].n_words, out[1].n_removed, out[3].n_removed) == (WORDS, 0, 20)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert (out[1].n_lines, out[1].n_removed) == (WORDS // 50, 0)
    out = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert out[1].n_shingles == len({tuple(w) for w in zip(*(long.split()[k:] for k in range(5)))}) and out[1].kept


def test_words(spark, docs, long):
    out = {r.doc_id: r for r in quality.measure(docs).collect()}
    assert out[1].n_words == WORDS and out[1].word_chars == len(re.sub(r"\s", "", long)) and out[1].n_repeat_words == 120
    bench = spark.createDataFrame([(7, " ".join(f"passage{k}" for k in range(30, 60)))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 7)}
    found = lexical.search(docs, bench).collect()
    assert [(r.doc_id, r["rank"]) for r in found] == [(1, 1)]
    report = divergence.source_divergence(docs, least=1).where("lang = 'en' and part = 'pair'")
    assert report.count() == 0 and divergence.term_vectors(docs.na.fill(""), 1).where("term = 'passage'").first().total == 120
    said = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert said[1] in ("en", "de") and said[4] == "und"


def test_rows(spark, docs, long):
    out = {r.doc_id: r for r in sharding.assign_shards(docs).collect()}
    assert out[1]["size"] == len(long) + 1 and out[1].text_crc32 == zlib.crc32(long.encode())
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.n_tokens for r in mixing.document_rates(docs, labels).where("doc_id = 1").collect()} == {WORDS}
    turns = spark.createDataFrame([(0, 0, "user", long), (0, 1, "assistant", "a"), (1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    row = chat_format.format_preferences(chat_format.neighbours_as_pairs(chat_format.conversations_as_rows(turns))).first()
    assert row.n_prompt_turns == 1 and long in row.prompt and long in row.rejected
    pages = spark.createDataFrame([(1, "https://a.org/", long), (2, "https://b.org/", long), (3, "https://c.org/", "x")], "page_id long, url string, html string")
    folder = common.new_path(spark, "warc-long")
    warc.write_warc(pages, folder)
    back = {r.page_id: r for r in warc.read_warc(spark, folder).collect()}
    digest = hashlib.sha256(long.encode()).hexdigest()
    assert back[1].payload.decode() == long and (back[2].payload_bytes, back[2].payload_digest, back[2].refers_to) == (len(long), digest, 1)
