"""Fetching frontiers of links: files, memory, the web; and the routing of what comes back.

A source maps a DataFrame with a column ``path`` to rows (path, html, status). One that
fetches in tasks of its own gives, if ``timed``, the columns of ``meter.TIMES`` as well.
"""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from time import perf_counter_ns
from typing import Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import schema
from linkloom.functions.links import page_url
from linkloom.functions.meter import TIMES, metered
from linkloom.scratch import qualified


class Source(Protocol):
    def __call__(self, frontier: DataFrame) -> DataFrame: ...


def page_name(path: Column) -> Column:
    """The third piece between slashes (``/wiki/Name``); null where there is none."""
    return F.get(F.split(path, "/"), F.lit(2))


def _joined(frontier: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` has name and html; a name that is not there does not exist."""
    asked = frontier.select("path").distinct().withColumn("name", page_name(F.col("path")))
    known = known.select("name", "html").join(asked.select("name"), "name", "left_semi")
    found = asked.join(known, "name", "left")
    return found.select("path", "html", F.when(F.col("html").isNull(), schema.DOES_NOT_EXIST).otherwise(schema.SUCCESS).alias("status"))


ROWS = f"path string, html string, status string, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in TIMES)}"


def _each(asked: DataFrame, opened: Callable[[], Callable[[str | None], tuple[str | None, str]]], timed: bool) -> DataFrame:
    """Rows of ``asked`` (path, and what to fetch), each fetched where its partition lies; ``opened`` makes the task's function to (html, status)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch, worker = opened(), TaskContext.get().partitionId()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, statuses, took = [], [], []
            for what in batch.column(1).to_pylist():
                began = perf_counter_ns()
                text, status = fetch(what)
                texts.append(text)
                statuses.append(status)
                took.append((perf_counter_ns() - began) // 1000)
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(statuses, pa.string()), pa.array([worker] * len(took), pa.int32()), pa.array(took, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["path", "html", "status", "worker", "took_us"])

        yield from metered(batches, work)

    fetched = asked.mapInArrow(run, ROWS)
    return fetched if timed else fetched.select("path", "html", "status")


@dataclass
class FileSource:
    """Pages in ``<folder>/<name>.txt``: each frontier row opens its own file where its partition lies.

    Tasks open files through ``pyarrow.fs``, so only what is asked for is read. A path
    without a name, or a file that is not there, does not exist; a file that cannot be
    read just now is a connection error.
    """

    folder: str
    timed: bool = False

    def __call__(self, frontier: DataFrame) -> DataFrame:
        folder = qualified(frontier.sparkSession, self.folder)

        def opened():
            from pyarrow import fs

            files, root = fs.FileSystem.from_uri(folder)

            def fetch(name: str | None) -> tuple[str | None, str]:
                if not name:
                    return None, schema.DOES_NOT_EXIST
                try:
                    with files.open_input_stream(f"{root}/{name}.txt") as f:
                        return f.read().decode("utf-8", "replace"), schema.SUCCESS
                except (FileNotFoundError, ValueError):  # no such file, or no name that a file can have
                    return None, schema.DOES_NOT_EXIST
                except OSError:
                    return None, schema.CONNECTION_ERROR

            return fetch

        return _each(frontier.select("path").distinct().withColumn("name", page_name(F.col("path"))), opened, self.timed)


def text_files(spark, folder: str) -> DataFrame:
    """(name, html) of every ``*.txt`` file of a folder."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    name = F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"(?s)^(.*)\.txt$", 1)
    return files.select(name.alias("name"), F.col("value").alias("html"))


@dataclass
class TableSource:
    """Pages in a table (name, html)."""

    pages: DataFrame

    def __call__(self, frontier: DataFrame) -> DataFrame:
        return _joined(frontier, self.pages)

    def add(self, new: DataFrame) -> TableSource:
        """With further pages; a name that is there already keeps its page."""
        return TableSource(self.pages.unionByName(new.join(self.pages.select("name"), "name", "left_anti").select(*self.pages.columns)))

    def remove(self, names: DataFrame) -> TableSource:
        return TableSource(self.pages.join(names.select("name"), "name", "left_anti").select(*self.pages.columns))


@cache
def _opener():
    """One for all fetches of a process; redirects are not followed."""
    import urllib.request

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args, **kwargs):
            return None

    return urllib.request.build_opener(Stay)


def http_get(url: str, timeout: float = 10.0) -> str:
    """The page behind a URL; redirects are not followed."""
    with _opener().open(url, timeout=timeout) as answer:
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


def status_of(error: BaseException) -> str:
    """An unknown host or a time-out may pass; any other failure means that there is no such page."""
    reason = getattr(error, "reason", error)
    passing = (socket.gaierror, TimeoutError)
    return schema.CONNECTION_ERROR if isinstance(reason, passing) or isinstance(error, passing) else schema.DOES_NOT_EXIST


@dataclass
class WebSource:
    """Pages of a site, each frontier row fetched once where its partition lies; ``transport`` maps a URL to its text."""

    transport: Callable[[str], str] = http_get
    lang: str = "en"
    parallelism: int | None = None
    timed: bool = False

    def __call__(self, frontier: DataFrame) -> DataFrame:
        transport = self.transport

        def fetch(url: str | None) -> tuple[str | None, str]:
            try:
                return transport(url), schema.SUCCESS
            except Exception as e:  # noqa: BLE001  the row says what happened
                return None, status_of(e)

        asked = frontier.select("path").distinct().withColumn("url", page_url(F.col("path"), self.lang))
        if self.parallelism:
            asked = asked.repartition(self.parallelism, "path")
        return _each(asked, lambda: fetch, self.timed)


@dataclass
class RecordedSource:
    """Replays fetches that were recorded (path, html, status); a path without a record does not exist."""

    fetches: DataFrame

    def __call__(self, frontier: DataFrame) -> DataFrame:
        asked = frontier.select("path").distinct()
        # a small frontier goes to the records; the records would all be shuffled to meet it from the left
        known = self.fetches.select("path", "html", "status").join(asked, "path", "left_semi")
        found = asked.join(known, "path", "left")
        return found.select("path", "html", F.coalesce("status", F.lit(schema.DOES_NOT_EXIST)).alias("status"))


@dataclass
class ScriptedSource:
    """Wraps a source with statuses that a rule decides, for tests and rehearsals."""

    source: Source
    status: Column

    def __call__(self, frontier: DataFrame) -> DataFrame:
        out = self.source(frontier).withColumn("status", F.coalesce(self.status, "status"))
        return out.withColumn("html", F.when(F.col("status") == schema.SUCCESS, F.col("html")))
