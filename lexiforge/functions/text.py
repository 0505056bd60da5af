"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[ \t\n\r\f\x0B]"
#: Characters that are unusual in prose, and the CJK ranges.
SPECIAL = r"""[{}\[\]()<>|&^$#@!%*+=~`\\/:;,"']"""
CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]"
#: Words that the ranking ignores.
STOP_WORDS = (
    "a an the and or but in on at to for of by with from as is was are were be been being have has had do does did will would could "
    "should may might shall can need it its this that these those i me my we our you your he him his she her they them their not no nor "
    "so if then than too very just about above after again all also any because before between both each few more most much neither now "
    "once only other own same some such through thus under until up while who whom what which why where when how"
).split()
#: Letters of other alphabets and the ASCII letters they look like.
LOOKALIKES = ("аеорсухіјѕһԁαεικνορτυ", "aeopcyxijshdaeiknoptu")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f\x0B]+"), 0)


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def _count(word: Column, pattern: str) -> Column:
    return F.length(word) - F.length(F.regexp_replace(word, pattern, ""))


def token_sum(text: Column) -> Column:
    """The tokens of a text's words; what two texts with a space or a line break between them cost is their sum."""
    n = F.length
    cost = lambda w: (
        # most words have neither CJK letters nor unusual characters, and are not searched for them
        F.when(w.rlike(r"^[A-Za-z0-9._?-]+$"), F.when(n(w) <= 7, 1).otherwise(F.ceil(n(w) / 4).cast("int"))).when(_count(w, CJK) > n(w) * 0.5, n(w)).when(_count(w, SPECIAL) > n(w) * 0.4, n(w)).when(n(w) <= 7, 1).otherwise(F.ceil(n(w) / 4).cast("int"))
    )
    return F.aggregate(words(text), F.lit(0), lambda a, w: a + cost(w))


def estimate_tokens(text: Column) -> Column:
    """Tokens that a model would see: short words 1, longer ones a quarter of their letters, code and CJK letter by letter."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), token_sum(text)))


def clean_for_terms(text: Column) -> Column:
    """Lower case, without code, link targets and tags; what is left between words is not."""
    low = F.lower(F.coalesce(text, F.lit("")))
    t = low
    for pattern, by in ((r"(?s)```.*?```", " "), (r"`[^`]+`", " "), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", " "), (r"<[^>]+>", " ")):
        t = F.regexp_replace(t, pattern, by)
    return F.when(low.contains("`") | low.contains("](") | low.contains("<"), t).otherwise(low)


def terms(text: Column, least: int = 2, stop_words: list[str] | None = None) -> Column:
    """What the ranking counts: terms of two letters or more that are no stop words, repeats kept."""
    stop = STOP_WORDS if stop_words is None else stop_words
    # picked out: several times as fast as to replace what is no letter and to split
    return F.filter(F.regexp_extract_all(clean_for_terms(text), F.lit("[a-z0-9_-]+"), 0), lambda w: (F.length(w) >= least) & ~w.isin(stop))


def _normalized(form: str, change):
    """An expression for ``change`` of the normal form; only texts with letters beyond ASCII go through Python."""

    def of(text: Column) -> Column:
        beyond = text.rlike(r"[^\x00-\x7F]")
        by_python = F.pandas_udf(lambda texts: texts.map(lambda t: change(unicodedata.normalize(form, t)), na_action="ignore"), StringType())
        return F.when(beyond, by_python(F.when(beyond, text))).otherwise(text)

    return of


#: Compatible forms as one, and letters without their marks.
compatible = _normalized("NFKC", lambda t: t)
unmarked = _normalized("NFKD", lambda t: "".join(c for c in t if not unicodedata.combining(c)))


def fold_lookalikes(text: Column) -> Column:
    """Compatible forms as one, without invisible characters and combining marks; lookalikes as ASCII."""
    bare = F.regexp_replace(compatible(text), r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{00AD}\x{0300}-\x{036F}]", "")
    return F.translate(bare, *LOOKALIKES)


def slug(text: Column, most: int = 48) -> Column:
    """Lower-case ASCII words joined by ``-``; ``query`` for none."""
    plain = F.lower(unmarked(F.coalesce(text, F.lit(""))))
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, most), "-+$", "")
    return F.when(cut == "", "query").otherwise(cut)


#: Escape sequences of terminals, characters of no width, and ranges of two columns each.
_ESCAPES, _NO_WIDTH = r"\x1B\[[0-?]*[ -/]*[@-~]", r"[\p{Mn}\p{Me}\p{Cf}\x00-\x1F\x7F-\x9F]"
_WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}]"


def visible_width(text: Column) -> Column:
    """The columns that a text takes in a terminal."""
    seen = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _ESCAPES, ""), _NO_WIDTH, "")
    return (F.length(seen) * 2 - F.length(F.regexp_replace(seen, _WIDE, ""))).cast("int")


def cut_to_width(text: Column, most: int, mark: str = "…") -> Column:
    """The beginning of a text that takes at most ``most`` columns, with a mark if it is cut; escape sequences go when it is."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _ESCAPES, ""), r"[\x00-\x1F\x7F-\x9F]", "")
    none = F.struct(F.lit("").alias("kept"), F.lit(0).alias("used"), F.lit(True).alias("on"))
    letters = F.slice(F.filter(F.split(plain, ""), lambda c: c != ""), 1, 4 * most + 4)  # marks of no width do not count

    def step(a, c):
        used = a["used"] + visible_width(c)
        fits = a["on"] & (used <= most - len(mark))
        return F.struct(F.when(fits, F.concat(a["kept"], c)).otherwise(a["kept"]).alias("kept"), used.alias("used"), fits.alias("on"))

    return F.when(visible_width(text) <= most, F.coalesce(text, F.lit(""))).otherwise(F.concat(F.aggregate(letters, none, step, lambda a: a["kept"]), F.lit(mark)))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def short_hash(text: Column, n: int = 12) -> Column:
    return F.substring(content_hash(text), 1, n)


def unescape_xml(text: Column) -> Column:
    t = text
    for name, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(by))
    return t


def strip_markdown(text: Column) -> Column:
    """Prose without Markdown's marks."""
    t = text
    for pattern, by in (
        (r"(?s)```[^\n]*\n(.*?)```", "$1"),
        (r"`([^`]+)`", "$1"),
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"(?m)^#{1,6}[ \t]+", ""),
        (r"(?m)^[ \t]*>[ \t]?", ""),
        (r"(?m)^[ \t]*[-*+][ \t]+", ""),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"__([^_]+)__", "$1"),
        (r"\*([^*\n]+)\*", "$1"),
    ):
        t = F.regexp_replace(t, pattern, by)
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def round_half_up(x: Column, digits: int = 3) -> Column:
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def compact_count(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M"))).when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000), F.lit("K"))).otherwise(n.cast("string"))
