"""Extractors and hooks of the user's own: tried before the built-in ones, and never the end of a job.

An extractor is a polymorphic table function over TABLE arguments: it returns whatever columns came in, and what it made of each row.
One that fails for a row is skipped for that row and named in ``skipped``; the next one that matches is tried, then the built-in sites.
"""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lexiforge.operators.verticals import render_answers

ADDED = ["vertical", "key", "markdown", "via", "skipped"]
#: The longest pattern of a hook.
MOST_PATTERN = 4096


@dataclass(frozen=True)
class Extractor:
    """``match(url)`` says whether it is for a URL; ``extract(url, body)`` gives Markdown, or None to leave the row to the next one."""

    name: str
    match: Callable[[str], bool]
    extract: Callable[[str, str | None], str | None]


@dataclass(frozen=True)
class Hook:
    """For the URLs that ``pattern`` matches (* within a part of a path, ** across parts): changes what was fetched, or what was extracted."""

    pattern: str
    after_fetch: Callable[[str, str | None], str | None] | None = None
    after_extract: Callable[[str, str | None], str | None] | None = None


def load_extractors(folder: str) -> tuple[list[Extractor], list[str]]:
    """The extractors of the Python files of a folder (each with name, match and extract), and why others are none; no folder, none."""
    found, problems = [], []
    for path in sorted(Path(folder).glob("*.py")) if Path(folder).is_dir() else []:
        spec = importlib.util.spec_from_file_location(f"lexiforge_user_{path.stem}", path)
        module = importlib.util.module_from_spec(spec)
        try:
            spec.loader.exec_module(module)
            name = getattr(module, "name", None)
            if not isinstance(name, str) or not name.strip():
                raise ValueError('missing or empty string "name"')
            for part in ("match", "extract"):
                if not callable(getattr(module, part, None)):
                    raise ValueError(f'missing or non-function "{part}"')
            module.match("https://example.com/")
        except Exception as e:  # one file that is none leaves the others as they are
            problems.append(f"{path.name}: {e}")
            continue
        import sys

        sys.modules[spec.name] = module
        cloudpickle.register_pickle_by_value(module)  # executors do not see the folder
        found.append(Extractor(name, module.match, module.extract))
    return found, problems


def extracted(answers: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """answers (url, body, others) with vertical, key, markdown, via (user, built-in or null) and skipped (the extractors that failed)."""

    class Run:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            schema = StructType(list(rows.dataType.fields))
            for name in ADDED:
                schema = schema.add(name, StringType())
            return AnalyzeResult(schema)

        def eval(self, row):
            failed, out, by = [], None, None
            for e in extractors:
                try:
                    out = e.extract(row["url"], row["body"]) if e.match(row["url"]) else None
                    if out is not None and not isinstance(out, str):
                        raise TypeError("an extractor gives text")
                except Exception as problem:
                    failed.append(f"{e.name}: {problem}")
                    out = None
                if out is not None:
                    by = e.name
                    break
            yield (*row, by, row["url"] if by else None, out, "user" if by else None, "; ".join(failed) or None)

    rows = answers.drop(*ADDED)
    tried = F.udtf(Run)(rows.asTable())
    own = [F.col(f"`{c}`") for c in rows.columns]
    rest = render_answers(tried.where("via is null").drop("vertical", "key", "markdown", "via").where("url is not null"))
    built_in = rest.select(*own, "vertical", "key", "markdown", F.lit("built-in").alias("via"), "skipped")
    from lexiforge.operators.verticals import vertical

    none = tried.where(F.col("via").isNull() & vertical(F.col("url")).isNull())
    return tried.where("via is not null").select(*own, *ADDED).unionByName(built_in).unionByName(none.select(*own, *ADDED))


def glob_pattern(pattern: str) -> str:
    """A pattern of URLs as a regular expression."""
    parts = re.split(r"(\*\*/?|\*)", pattern[:MOST_PATTERN])
    return "^" + "".join({"**": ".*", "**/": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts) + "$"


def hooked(pages: DataFrame, hooks: list[Hook], column: str, after: str = "after_fetch", url_col: str = "url") -> DataFrame:
    """``pages`` with ``column`` as the hooks leave it: those that match, one after the other; one that fails or gives None changes nothing."""
    chain = [(re.compile(glob_pattern(h.pattern), re.S), getattr(h, after)) for h in hooks if getattr(h, after)]
    if not chain:
        return pages

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for urls, values in batches:
            out = []
            for url, value in zip(urls, values, strict=True):
                for pattern, change in chain:
                    try:
                        new = change(url, value) if url is not None and pattern.match(url) else None
                    except Exception:  # a hook of the user's never ends the job
                        new = None
                    value = value if new is None else new
                out.append(value)
            yield pd.Series(out, dtype="object")

    matched = F.lit(False)
    for h in hooks:
        if getattr(h, after):
            matched |= F.coalesce(F.col(url_col).rlike("(?s)" + glob_pattern(h.pattern)), F.lit(False))
    changed = F.pandas_udf(run, "string")(F.col(url_col), F.col(column))
    return pages.withColumn(column, F.when(matched, changed).otherwise(F.col(column)))
