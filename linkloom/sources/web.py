"""The web as a Spark data source: a frontier's URLs in, one row per URL out, whatever happens to the fetch.

The frontier lies as a table in the shared folder, dealt by host: a partition of the
scan reads the hosts of one lane, so a host is asked by one task alone, at the rate it
bears and over no more connections at once than it is granted, and no more tasks ask at
once than there are lanes.
"""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cache
from queue import SimpleQueue

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linkloom import schema
from linkloom.functions.links import page_url
from linkloom.functions.meter import handed_over
from linkloom.scratch import new_path

NAME = "linkloom_web"
ROWS = "path string, html string, status string, worker int, took_us long, starved_us long, blocked_us long"
#: Rows that go to Spark at once.
BATCH = 100


class _Stay(urllib.request.HTTPRedirectHandler):
    """Redirects are not followed."""

    def redirect_request(self, *args, **kwargs):
        return None


@cache
def _opener() -> urllib.request.OpenerDirector:
    """One for all fetches of a process: making one reads the system's certificates, which takes longer than a page."""
    return urllib.request.build_opener(_Stay)


def get(url: str, deadline_s: float) -> str:
    """The page behind a URL within a time that holds for the whole of the fetch, not for each packet."""
    end = time.monotonic() + deadline_s
    with _opener().open(url, timeout=deadline_s) as answer:
        parts = []
        while part := answer.read1(1 << 16):
            parts.append(part)
            if time.monotonic() > end:
                raise TimeoutError(url)
        return b"".join(parts).decode(answer.headers.get_content_charset() or "utf-8", "replace")


@dataclass
class Lane(InputPartition):
    number: int


class WebReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.lanes = options["frontier"], int(options["lanes"])
        self.gap_s, self.deadline_s = 1.0 / float(options["rate"]), float(options["deadline"])
        self.connections = int(options.get("connections", "1"))

    def partitions(self) -> list[Lane]:
        return [Lane(k) for k in range(self.lanes)]

    def read(self, partition: Lane) -> Iterator[pa.RecordBatch]:
        from linkloom.sources.fetch import status_of

        names = [c.split()[0] for c in ROWS.split(", ")][:-1]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        batch = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        done: SimpleQueue = SimpleQueue()

        def fetch(path: str, url: str, wait: float) -> None:
            began = time.monotonic()
            try:
                html, status = get(url, self.deadline_s), schema.SUCCESS
            except Exception as e:  # noqa: BLE001  the row says what happened
                html, status = None, status_of(e)
            done.put((path, html, status, partition.number, int((time.monotonic() - began) * 1e6), int(max(wait, 0) * 1e6)))

        rows, before, running = [], {}, 0
        with ThreadPoolExecutor(self.connections) as pool:
            for path, url, host in _frontier(f"{self.folder}/lane={partition.number}"):
                if running == self.connections:  # whichever is first makes room
                    rows.append(done.get())
                    running -= 1
                # hosts of a lane take turns as they stand; each has its own clock
                wait = before.get(host, 0.0) + self.gap_s - time.monotonic()
                if wait > 0:  # the host's rate starves the lane
                    time.sleep(wait)
                began = time.monotonic()
                before = {host: began, **{h: t for h, t in before.items() if h != host and began - t < self.gap_s}}
                pool.submit(fetch, path, url, wait)
                running += 1
                if len(rows) >= BATCH:
                    yield from handed_over(batch())
                    rows = []
            rows += [done.get() for _ in range(running)]
        if rows:
            yield from handed_over(batch())


def _frontier(folder: str) -> Iterator[tuple[str, str, str]]:
    """(path, url, host) of one lane, read a batch at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as source, pq.ParquetFile(source) as part:
                for batch in part.iter_batches(BATCH, columns=["path", "url", "host"]):
                    yield from zip(*(c.to_pylist() for c in batch.columns))


class WebPages(DataSource):
    """Options: ``frontier`` (folder of path, url, host by lane), ``lanes``, ``rate`` (fetches a second and host), ``deadline`` (seconds a fetch), ``connections`` (fetches of a lane, and so of a host, at once)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> WebReader:
        return WebReader(self.options)


@dataclass
class HttpSource:
    """Pages of a site, fetched by the data source; ``url`` makes a URL of a path (the site's own by default).

    A URL that cannot be fetched in time, or whose host is not known, is a connection
    error; every other failure, redirects included, means that there is no such page.
    """

    url: object = None
    lanes: int = 8
    rate: float = 1e6
    deadline_s: float = 10.0
    timed: bool = False
    #: Fetches of a host at once.
    connections: int = 1

    def __call__(self, frontier: DataFrame) -> DataFrame:
        spark = frontier.sparkSession
        spark.dataSource.register(WebPages)
        asked = frontier.select("path").distinct()
        url = page_url(F.col("path"), "en") if self.url is None else self.url(F.col("path"))
        asked = asked.withColumn("url", url)
        # one host's URLs stay together: the host alone says which lane they are in
        asked = asked.withColumn("host", F.regexp_extract("url", r"^[^:]+://([^/?#]*)", 1)).withColumn("lane", F.pmod(F.xxhash64("host"), F.lit(self.lanes)))
        folder = new_path(spark, "frontier")
        asked.repartition("lane").write.partitionBy("lane").parquet(folder)
        fetched = spark.read.format(NAME).options(frontier=folder, lanes=str(self.lanes), rate=str(self.rate), deadline=str(self.deadline_s), connections=str(self.connections)).load()
        return fetched if self.timed else fetched.select("path", "html", "status")
