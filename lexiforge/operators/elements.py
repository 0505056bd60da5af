"""The elements of pages as rows: one parse gives the tree, the rest is arithmetic on rows.

A page's text is kept once; the text of an element is a stretch of it, and its descendants are a stretch of places, so what an
element holds (text, links, children) comes from sums and joins on places.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexiforge.sources.work import stored

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes: the tags that end at it, up to an element of the second list.
_BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
_ENDS = {
    **{t: ({"p"}, {"button", "td", "th", "li", "div", "article", "section", "body"}) for t in _BLOCKS},
    "li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select", "optgroup"}), "body": ({"head"}, {"html"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}


class Tree(HTMLParser):
    """Elements in order of their opening tags: [parent, tag, attributes, text start, text end, last descendant, length of the source inside]."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.open: list[int] = []
        self.begun: list[int] = []  # where each open element's content begins in the source
        self.texts: list[str] = []
        self.length = 0
        self.lines = [0, *accumulate(len(x) + 1 for x in source.split("\n"))]
        self.feed(source)
        self.close()
        while self.open:
            self._end(len(source))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _end(self, at: int) -> None:
        e = self.elements[self.open.pop()]
        e[4], e[5], e[6] = self.length, len(self.elements) - 1, max(0, at - self.begun.pop())

    def handle_starttag(self, tag, attrs):
        ends, until = _ENDS.get(tag, ((), ()))
        names = [self.elements[i][1] for i in self.open]
        stop = max((k for k, n in enumerate(names) if n in until), default=-1)
        first = next((k for k in range(stop + 1, len(names)) if names[k] in ends), len(names))
        at = self._at()
        while len(self.open) > first:
            self._end(at)
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        self.elements.append([self.open[-1] if self.open else -1, tag, own, self.length, self.length, len(self.elements), 0])
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)
            self.begun.append(at + len(self.get_starttag_text() or ""))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if any(self.elements[i][1] == tag for i in self.open):
            at = self._at()
            while self.elements[self.open[-1]][1] != tag:
                self._end(at)
            self._end(at)

    def handle_data(self, data):
        self.texts.append(data)
        self.length += len(data)


_LISTS = {"attributes": pa.map_(pa.string(), pa.string()), "ancestors": pa.list_(pa.int32()), "path": pa.list_(pa.string())}
_FIELDS = "place parent last tag attributes ancestors path address text_start text_length html_length sibling_index sibling_count".split()
_ELEMENT = pa.struct([(n, _LISTS.get(n) or (pa.string() if n in ("tag", "address") else pa.int32())) for n in _FIELDS])
#: Pages go to Spark as soon as so many characters of source have been parsed.
CHUNK = 1_000_000


def parse(html: str | None) -> dict:
    """The text of a page and its elements; ``address`` names an element by its tags and places among equal siblings."""
    tree = Tree(html or "")
    total, seen, out = Counter((e[0], e[1]) for e in tree.elements), Counter(), []
    for k, (parent, tag, own, start, end, last, inside) in enumerate(tree.elements):
        above = out[parent] if parent >= 0 else None
        n, at = total[parent, tag], seen[parent, tag]
        seen[parent, tag] += 1
        out.append({
            "place": k, "parent": parent, "last": last, "tag": tag, "attributes": own, "ancestors": [*above["ancestors"], parent] if above else [],
            "path": [*(above["path"] if above else []), tag], "address": (above["address"] if above else "") + f"/{tag}" + (f"[{at + 1}]" if n > 1 else ""),
            "text_start": start, "text_length": end - start, "html_length": inside, "sibling_index": at, "sibling_count": n,
        })
    return {"text": "".join(tree.texts), "elements": out}


def _chunk(pages: pa.Array, parsed: list[dict]) -> pa.RecordBatch:
    flat = [e for p in parsed for e in p["elements"]]
    columns = [pa.array([list(e[n].items()) if n == "attributes" else e[n] for e in flat], _ELEMENT.field(n).type) for n in _FIELDS]
    offsets = pa.array([0, *accumulate(len(p["elements"]) for p in parsed)], pa.int32())
    held = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(_ELEMENT)))
    return pa.RecordBatch.from_arrays([pages, pa.array([p["text"] for p in parsed], pa.string()), held], ["page", "_text", "elements"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task holds the parsed form of few pages at a time, however many a batch has."""
    for batch in batches:
        ids, sources = batch.columns
        begun, parsed, size = 0, [], 0
        for k in range(batch.num_rows):
            source = sources[k].as_py()
            parsed.append(parse(source))
            size += len(source or "")
            if size >= CHUNK or k + 1 == batch.num_rows:
                yield _chunk(ids.slice(begun, k + 1 - begun), parsed)
                begun, parsed, size = k + 1, [], 0


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page, place, parent, last, tag, attributes, ancestors, path, address, text_start, text_length, text, html_length, sibling_index, sibling_count.

    ``text`` is all text inside the element, that of scripts included; ids should be unique. A null page has no elements.
    """
    given = pages.select(F.col(id_col).alias("page"), F.col(html_col).alias("_html"))
    schema = StructType([given.schema["page"], StructField("_text", StringType()), StructField("elements", ArrayType(from_arrow_type(_ELEMENT)))])
    rows = given.mapInArrow(_parsed, schema).select("page", "_text", F.explode("elements").alias("e"))
    return rows.select("page", "e.*", F.substring("_text", F.col("e.text_start") + 1, F.col("e.text_length")).alias("text"))


#: Attributes that a mark holds.
MARKED = ["id", "class", "role", "itemprop", "itemtype", "name", "rel"]


def marks(rows: DataFrame) -> DataFrame:
    """``elements`` as page, place and mark, the struct that ``decisions.located`` compares."""
    links = rows.where("tag = 'a'").select("page", F.explode("ancestors").alias("place"), "text_length")
    linked = links.groupBy("page", "place").agg(F.sum("text_length").alias("linked"))
    children = rows.where("parent >= 0").groupBy("page", "parent", "tag").agg(F.count("*").cast("int").alias("n"))
    children = children.groupBy("page", F.col("parent").alias("place")).agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("children"))
    both = rows.join(linked, ["page", "place"], "left").join(children, ["page", "place"], "left")
    share = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(0.0)
    mark = F.struct(
        "path", share("text_length", "html_length").alias("text_density"), F.least(F.lit(1.0), share("linked", "text_length")).alias("link_density"),
        F.coalesce("children", F.create_map().cast("map<string,int>")).alias("children"), F.map_filter("attributes", lambda k, v: k.isin(MARKED) & (v != "")).alias("attributes"), "sibling_index", "sibling_count",
    )
    return both.select("page", "place", mark.alias("mark"))


#: Roles that make any element an action.
ACTION_ROLES = ["button", "link", "textbox", "searchbox", "combobox", "checkbox", "radio"]


def _attribute(name: str) -> Column:
    return F.col("attributes")[name]


def actions(rows: DataFrame, most: int | None = None) -> DataFrame:
    """page, ref, role, name, name_source, affordance, value, options, address: what a reader can act on, each (role, name, affordance) once, in order.

    ``rows``: ``elements``. All actions of a page, or the first ``most``. Hidden and disabled elements are left out, and what lies in a nav or footer below the body, main or article.
    """
    tag, kind = F.col("tag"), F.lower(F.coalesce(_attribute("type"), F.lit("")))
    acts = (
        ((tag == "a") & _attribute("href").isNotNull()) | ((tag == "button") & (F.coalesce(_attribute("type"), F.lit("")) != "hidden")) | ((tag == "input") & (F.coalesce(_attribute("type"), F.lit("")) != "hidden"))
        | tag.isin("select", "textarea", "form") | F.coalesce(_attribute("role").isin(ACTION_ROLES), F.lit(False)) | _attribute("onclick").isNotNull()
    )
    off = _attribute("disabled").isNotNull() | _attribute("hidden").isNotNull()
    for name in ("aria-disabled", "aria-hidden"):
        off |= F.coalesce(_attribute(name) == "true", F.lit(False))
    off |= (tag == "input") & (kind == "hidden")
    above = F.filter(F.reverse(F.slice("path", 1, F.size("path") - 1)), lambda t: t.isin("nav", "footer", "body", "main", "article"))
    off |= F.coalesce(F.get(above, 0).isin("nav", "footer"), F.lit(False))

    blank = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))
    field = tag.isin("input", "textarea")
    said = F.nullif(F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 100), F.lit(""))
    sources = [("aria-label", blank(_attribute("aria-label"))), ("placeholder", F.when(field, blank(_attribute("placeholder")))), ("value", F.when(field, blank(_attribute("value")))), ("text", said), ("title", blank(_attribute("title"))), ("alt", blank(_attribute("alt")))]
    name = F.coalesce(*(F.when(c.isNotNull(), F.struct(c.alias("name"), F.lit(s).alias("source"))) for s, c in sources), F.struct(F.concat(F.lit("["), tag, F.lit("]")).alias("name"), F.lit("tag").alias("source")))
    role = F.coalesce(
        F.nullif(_attribute("role"), F.lit("")), F.when(tag == "a", "link").when(tag.isin("button", "select", "form"), tag).when(tag == "textarea", "textbox"),
        F.when(tag == "input", F.when(kind == "submit", "button").when(kind.isin("checkbox", "radio"), kind).when(kind == "search", "searchbox").otherwise("textbox")), tag,
    )
    clicks = ["submit", "button", "reset", "checkbox", "radio", "file"]
    does = F.when(tag == "select", "select").when(tag == "textarea", "type").when(tag == "input", F.when(kind.isin(clicks), "click").otherwise("type")).when(tag == "form", "submit").otherwise("click")
    # the rows are read once: what acts, and the choices and their lists
    act, choice = F.coalesce(acts & ~off, F.lit(False)), F.coalesce(F.nullif(_attribute("value"), F.lit("")), blank(F.col("text")))
    rows = rows.where(act | tag.isin("option", "select")).select(
        "page", "place", "tag", "address", act.alias("act"), F.when(act, role).alias("role"), F.when(act, name).alias("n"), does.alias("affordance"), F.when(field, blank(_attribute("value"))).alias("value"),
        F.when(tag == "option", F.col("ancestors")).alias("ancestors"), F.when(tag == "option", choice).alias("choice"),
    )
    rows = stored(rows, "actions")
    found = rows.where("act").select("page", "place", "address", "role", "n.name", F.col("n.source").alias("name_source"), "affordance", "value")
    first = found.groupBy("page", "role", "name", "affordance").agg(F.min_by(F.struct("place", "address", "name_source", "value"), "place").alias("e")).select("page", "role", "name", "affordance", "e.*")
    ref = F.row_number().over(Window.partitionBy("page").orderBy("place"))
    top = first.withColumn("ref", ref)
    top = top if most is None else top.where(F.col("ref") <= most)
    choices = rows.where("tag = 'option'").select("page", "place", F.explode("ancestors").alias("of"), "choice")
    choices = choices.where("choice is not null").join(rows.where("tag = 'select'").select("page", F.col("place").alias("of")), ["page", "of"])
    choices = choices.groupBy("page", F.col("of").alias("place")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "choice"))), lambda x: x["choice"]).alias("options"))
    return top.join(choices, ["page", "place"], "left").select("page", "ref", "role", "name", "name_source", "affordance", "value", "options", "address")


def action_lines(acts: DataFrame) -> DataFrame:
    """page and text: a page's actions as a list of lines."""
    options = F.concat(F.lit(" options=["), F.array_join(F.slice("options", 1, 8), ","), F.when(F.size("options") > 8, F.concat(F.lit("...+"), (F.size("options") - 8).cast("string"))).otherwise(F.lit("")), F.lit("]"))
    line = F.concat(F.lit("["), F.col("ref").cast("string"), F.lit("] "), "role", F.lit(": "), "name", F.lit(" ("), "affordance", F.lit(")"), F.coalesce(F.concat(F.lit(' value="'), "value", F.lit('"')), F.lit("")), F.coalesce(options, F.lit("")))
    held = acts.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ref", line.alias("line")))).alias("lines"))
    return held.select("page", F.concat(F.lit("## Actions\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()
