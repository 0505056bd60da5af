"""A sink for files of pages, in batches and on streams, that shows all files of a write or none.

``df.write.format("page_files").mode("append").save(folder)`` writes a file for each row (path, text): a task writes below
``_staging/<its own name>``, and what it has written is listed in a file there. The commit reads the lists of the tasks that Spark
accepts, moves their files to their paths and records the write in ``_commits``; everything else in the staging folder goes, so a
task that failed, was lost or ran twice leaves nothing. If the write is aborted all of it goes. On a stream a batch that was
committed before is not written again.

The folder must be one that the driver and all executors share, of a scheme that ``pyarrow.fs`` knows (file, hdfs, s3, gs). A file
for each page is many small files: tables are better kept as Parquet, and this is for folders that other tools read.

Defined results: a null text is an empty file; a null or empty path, and one that leaves the folder, raise an error; of rows with one
path one stays, and a path that is there already is replaced.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

STAGING, COMMITS = "_staging", "_commits"


@dataclass
class TaskDone(WriterCommitMessage):
    name: str
    files: int


def _clean(path: str | None) -> str:
    plain = posixpath.normpath((path or "").replace("\\", "/")).lstrip("/")
    if plain in ("", ".") or plain.split("/")[0] in ("..", STAGING, COMMITS):
        raise ValueError(f"{path!r} is no path of a page")
    return plain


class _Files:
    """What the batch and the stream writer share."""

    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex
        store, base = self._base()
        store.create_dir(f"{base}/{STAGING}/{self.job}", recursive=True)
        store.open_output_stream(f"{base}/{STAGING}/{self.job}/open").close()

    def _ended(self, store: fs.FileSystem, base: str) -> bool:
        """Whether this is a task that outlived its write."""
        return store.get_file_info(f"{base}/{STAGING}/{self.job}/open").type == fs.FileType.NotFound

    def _base(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")

    def write(self, iterator: Iterator) -> TaskDone:
        store, base = self._base()
        name, listed = uuid.uuid4().hex, []
        here = f"{base}/{STAGING}/{self.job}/{name}"
        try:
            for k, row in enumerate(iterator):
                path = _clean(row["path"])
                if not k:
                    store.create_dir(here, recursive=True)
                with store.open_output_stream(f"{here}/{k}") as out:
                    out.write((row["text"] or "").encode())
                listed.append(path)
            if listed:
                with store.open_output_stream(f"{here}/list") as out:
                    out.write("\n".join(json.dumps(p) for p in listed).encode())
            if self._ended(store, base):
                raise RuntimeError("the write has ended")
        except BaseException:
            if store.get_file_info(here).type != fs.FileType.NotFound:
                store.delete_dir(here)
                self._tidy(store, base)
            raise
        return TaskDone(name, len(listed))

    def _publish(self, messages: list[TaskDone | None], record: str) -> None:
        store, base = self._base()
        if store.get_file_info(f"{base}/{COMMITS}/{record}").type == fs.FileType.NotFound:
            moved = 0
            for done in (m for m in messages if m and m.files):
                here = f"{base}/{STAGING}/{self.job}/{done.name}"
                with store.open_input_stream(f"{here}/list") as f:
                    paths = [json.loads(x) for x in f.read().decode().split("\n") if x]
                for folder in sorted({posixpath.dirname(p) for p in paths}):
                    store.create_dir(f"{base}/{folder}", recursive=True)
                last = {p: k for k, p in enumerate(paths)}
                with ThreadPoolExecutor(16) as pool:
                    list(pool.map(lambda x: store.move(f"{here}/{x[1]}", f"{base}/{x[0]}"), last.items()))  # noqa: B023
                moved += len(last)
            store.create_dir(f"{base}/{COMMITS}", recursive=True)
            with store.open_output_stream(f"{base}/{COMMITS}/{record}") as f:
                f.write(json.dumps({"files": moved, "tasks": sum(m is not None for m in messages)}).encode())
        self._forget()

    def _forget(self) -> None:
        store, base = self._base()
        if store.get_file_info(f"{base}/{STAGING}/{self.job}").type != fs.FileType.NotFound:
            if store.get_file_info(f"{base}/{STAGING}/{self.job}/open").type != fs.FileType.NotFound:
                store.delete_file(f"{base}/{STAGING}/{self.job}/open")
            store.delete_dir(f"{base}/{STAGING}/{self.job}")
        self._tidy(store, base)

    def _tidy(self, store: fs.FileSystem, base: str) -> None:
        """Takes empty staging folders away."""
        for folder in (f"{base}/{STAGING}/{self.job}", f"{base}/{STAGING}"):
            if store.get_file_info(folder).type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(folder)):
                store.delete_dir(folder)


class _BatchWriter(_Files, DataSourceWriter):
    def commit(self, messages: list[TaskDone | None]) -> None:
        self._publish(messages, f"{self.job}.json")

    def abort(self, messages: list[TaskDone | None]) -> None:
        self._forget()


class _StreamWriter(_Files, DataSourceStreamWriter):
    """Spark makes a new one for a batch's tasks and for its commit, so all share a staging folder: one stream for each folder."""

    def __init__(self, folder: str):
        self.folder, self.job = folder, "stream"

    def _ended(self, store: fs.FileSystem, base: str) -> bool:
        return False

    def commit(self, messages: list[TaskDone | None], batchId: int) -> None:
        self._publish(messages, f"batch-{batchId}.json")

    def abort(self, messages: list[TaskDone | None], batchId: int) -> None:
        self._forget()


class PageFiles(DataSource):
    """Register it (``spark.dataSource.register(PageFiles)``) before use."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("page_files appends: give it a new folder to begin anew")
        return _BatchWriter(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options["path"])


def as_files(pages: DataFrame) -> DataFrame:
    """``pages`` (url, title, markdown) as the rows of the sink: the path that the url gives and the page below its front matter."""
    from lexiforge.functions.urls import page_path
    from lexiforge.sources.corpus import page_files

    return page_files(pages).select(page_path(F.col("url")).alias("path"), F.col("file_text").alias("text"))
