"""Queries over keyed streams and the web data source."""

from __future__ import annotations

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.plans.graph_queries import _EDGES, part_edges
from linkloom.plans.registry import query
from linkloom.plans.state_queries import _TTL, _span
from linkloom.scratch import filesystem, new_path, written
from linkloom.sources.tables import table
from linkloom.sources.web import HttpSource
from linkloom.streaming import stateful


#: Files of a micro-batch, so that as many tasks write and read it.
FILES = 12


def _drained(spark, stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives over what is there now."""
    out = new_path(spark, name)
    with stateful.rocksdb(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start(out)
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _arriving(spark, batches: list[DataFrame], name: str, files: int = 1) -> DataFrame:
    """Tables as one stream, each a micro-batch of so many files, in their order."""
    folder = new_path(spark, name)
    for k, batch in enumerate(batches):
        part = f"{folder}/{k:03}"
        # the source takes files one by one, as they were written
        (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.parquet(part)
        store, where = filesystem(spark, part)
        for _ in range(files - sum(f.getPath().getName().endswith(".parquet") for f in store.listStatus(where))):
            batch.limit(0).coalesce(1).write.mode("append").parquet(part)  # few rows: empty files keep the batches apart
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")


def _by_hash(rows: DataFrame, n: int) -> list[DataFrame]:
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(n))
    return [rows.where(part == k) for k in range(n)]


@query(
    "due_links",
    f"""WITH v AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS path, epoch_us(ts) // 1000 AS t FROM events WHERE user_id IS NOT NULL),
    n AS (SELECT path, t, lead(t) OVER (PARTITION BY path ORDER BY t) AS nxt, {_TTL} AS ttl, (SELECT max(epoch_us(ts) // 1000) FROM events) AS last FROM v)
    SELECT path, t + ttl + 1 AS due_ms FROM n WHERE coalesce(nxt - t > ttl, t + ttl + 1 <= last)""",
)
def due_links(spark, sf_dir):
    """The log as a stream in order of time: a timer for each link, put off by each visit, tells when it is due."""
    _, ttl = _span(spark, sf_dir)
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("at"))
    high, _ = _span(spark, sf_dir)
    at_ms = F.unix_millis("at")
    # all but the last six spans of the ttl, then three, then the rest
    visits = _arriving(spark, [log.where(at_ms < high - 6 * ttl), log.where((at_ms >= high - 6 * ttl) & (at_ms < high - 3 * ttl)), log.where(at_ms >= high - 3 * ttl)], "log", FILES)
    return _drained(spark, stateful.due_links(visits, ttl), "due")


@query("stream_late_edges", f"WITH {_EDGES} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM e JOIN part ON p_partkey = dst WHERE p_size <= 40")
def stream_late_edges(spark, sf_dir):
    """Links and pages as two streams of several micro-batches each; a link becomes an edge when both are there, whichever came first."""
    edges = part_edges(spark, sf_dir).select(F.col("src").cast("string").alias("src_path"), F.col("dst").cast("string").alias("dst_path"))
    pages = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").cast("string").alias("path"))
    edges = written(edges, "edges")  # each batch is a part of them
    both = stateful.late_edges(_arriving(spark, _by_hash(edges, 2), "links", FILES), _arriving(spark, _by_hash(pages, 3), "pages", FILES))
    return _drained(spark, both, "late")


class _Site(BaseHTTPRequestHandler):
    """Answers by the number at a path's end: redirects, pages that are missing, and some that come too late."""

    def do_GET(self):
        key = int(self.path.rsplit("/", 1)[1])
        if key % 97 == 5:
            time.sleep(SLOW_S)
        status = 302 if key % 7 == 1 else 404 if key % 7 == 2 else 200
        body = f"page at {self.path}".encode()
        self.send_response(status)
        if status == 302:
            self.send_header("Location", "/wiki/0")
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        try:
            self.wfile.write(body)
        except OSError:
            pass  # whoever asked has gone

    def log_message(self, *args):
        pass


class _Server(ThreadingHTTPServer):
    daemon_threads = True
    request_queue_size = 128

    def handle_error(self, request, client_address):
        pass  # a client that has gone


DEADLINE_S, SLOW_S = 2.0, 4.0
#: Fetches that a server answers at once, so that a slow page does not hold up the others.
CONNECTIONS = 16


@query(
    "fetch_http",
    """SELECT '/wiki/' || page_id AS path, CASE WHEN page_id % 97 = 5 THEN 'CONNECTION_ERROR' WHEN page_id % 7 IN (1, 2) THEN 'DOES_NOT_EXIST' ELSE 'SUCCESS' END AS status,
    CASE WHEN page_id % 97 <> 5 AND page_id % 7 NOT IN (1, 2) THEN 'page at /wiki/' || page_id END AS html FROM pages""",
)
def fetch_http(spark, sf_dir):
    """All pages' paths fetched over HTTP from a server that runs beside the driver: found, moved, missing, or too slow. Fetched once; rows are written."""
    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    servers = [_Server((host, 0), _Site) for _ in range(4)]
    for server in servers:
        threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        sites = F.array(*[F.lit(f"http://{host}:{server.server_address[1]}") for server in servers])
        url = lambda path: F.concat(F.get(sites, F.pmod(F.xxhash64(path), F.lit(4)).cast("int")), path)
        asked = table(spark, sf_dir, "pages").select(F.concat(F.lit("/wiki/"), F.col("page_id").cast("string")).alias("path"))
        return written(HttpSource(url, lanes=8, deadline_s=DEADLINE_S, connections=CONNECTIONS)(asked), "fetched")
    finally:
        for server in servers:
            server.shutdown()
            server.server_close()
