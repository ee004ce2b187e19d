"""Keyed streams, the web data source, quotas and stopping."""

import random
import threading
import time
from datetime import UTC, datetime, timedelta

from fixtures import GRAPH, html
from pyspark.sql import functions as F

from linkloom.functions.html import fixture_analyzer
from linkloom.operators import crawl
from linkloom.operators.store import GraphStore
from linkloom.plans import stream_queries as q
from linkloom.sources.fetch import TableSource
from linkloom.sources.web import HttpSource
from linkloom.streaming import stateful


def test_links_fall_due_whatever_the_batches(spark):
    r = random.Random(2)
    base = datetime(2024, 1, 1, tzinfo=UTC)
    visits = sorted((r.randrange(5000), f"l{r.randrange(6)}") for _ in range(80)) + [(6000, "end")]
    want = set()
    for link in {p for _, p in visits}:
        times = sorted({t for t, p in visits if p == link})
        for t, after in zip(times, [*times[1:], None]):
            if (after is not None and after - t > 300) or (after is None and t + 301 < 6000):
                want.add((link, int(base.timestamp() * 1000) + t + 301))
    for cuts in ([0, 10_000], [0, 1500, 1501, 4000, 10_000]):
        rows = [[(p, base + timedelta(milliseconds=t)) for t, p in visits if a <= t < b] for a, b in zip(cuts, cuts[1:])]
        tables = [spark.createDataFrame(part, "path string, at timestamp") for part in rows]
        found = q._drained(spark, stateful.due_links(q._arriving(spark, tables, "visits"), 300), "due").collect()
        assert len(found) == len(want) and {(x.path, x.due_ms) for x in found} == want


def test_waiting_links_become_edges_in_any_order(spark):
    links = [[("a", "x"), ("b", "x"), ("a", "y")], [("a", "x"), ("c", "z"), (None, "x")], [("d", "x"), ("b", "x")]]
    pages = [[("y",)], [("x",), ("x",)], [("q",)]]
    stated = q._arriving(spark, [spark.createDataFrame(x, "src_path string, dst_path string") for x in links], "links")
    come = q._arriving(spark, [spark.createDataFrame(x, "path string") for x in pages], "pages")
    found = [tuple(r) for r in q._drained(spark, stateful.late_edges(stated, come), "late").collect()]
    assert sorted(found) == [("a", "x"), ("a", "y"), ("b", "x"), ("d", "x")]


def test_web_rows_tell_what_happened(spark):
    server = q._Server(("127.0.0.1", 0), q._Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_address[1]
    url = lambda path: F.when(path == "/wiki/77", F.lit("http://no-such-host.invalid/77")).otherwise(F.concat(F.lit(f"http://127.0.0.1:{port}"), path))
    asked = spark.createDataFrame([(f"/wiki/{k}",) for k in (3, 1, 2, 5, 77, 10, 3)], "path string")
    rows = {r.path: r for r in HttpSource(url, lanes=3, deadline_s=1.5, timed=True)(asked).collect()}
    statuses = {p[6:]: r.status for p, r in rows.items()}
    assert statuses == {"3": "SUCCESS", "1": "DOES_NOT_EXIST", "2": "DOES_NOT_EXIST", "5": "CONNECTION_ERROR", "77": "CONNECTION_ERROR", "10": "SUCCESS"}
    assert rows["/wiki/3"].html == "page at /wiki/3" and rows["/wiki/1"].html is None and 1e6 < rows["/wiki/5"].took_us < 4e6
    began = time.monotonic()
    slow = spark.createDataFrame([(f"/wiki/{7 * k}",) for k in range(1, 7)], "path string")
    assert HttpSource(url, lanes=4, rate=5)(slow).where("status = 'SUCCESS'").count() == 6
    assert time.monotonic() - began > 1.0  # six fetches from one host, five a second
    server.shutdown()
    server.server_close()


def test_slow_pages_do_not_hold_up_a_host(spark):
    server = q._Server(("127.0.0.1", 0), q._Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = lambda path: F.concat(F.lit(f"http://127.0.0.1:{server.server_address[1]}"), path)
    keys = [5 + 97 * k for k in range(8)] + [7 * k for k in range(1, 60)]
    asked = spark.createDataFrame([(f"/wiki/{k}",) for k in keys], "path string")
    began = time.monotonic()
    rows = HttpSource(url, lanes=2, deadline_s=1.5, connections=8)(asked).collect()
    assert time.monotonic() - began < 8 * 1.5  # one after another the slow ones alone take that long
    assert {(r.path, r.status) for r in rows} == {(f"/wiki/{k}", "CONNECTION_ERROR" if k % 97 == 5 else "SUCCESS") for k in keys} and len(rows) == len(keys)
    server.shutdown()
    server.server_close()


def test_late_edges_stay_within_spark(spark):
    links = q._arriving(spark, [spark.createDataFrame([("a", "x")], "src_path string, dst_path string")] * 2, "links", 3)
    pages = q._arriving(spark, [spark.createDataFrame([("x",)], "path string")], "pages", 3)
    shown = stateful.late_edges(links, pages)._jdf.queryExecution().analyzed().toString()
    assert "Python" not in shown and "Pandas" not in shown
    assert [tuple(r) for r in q._drained(spark, stateful.late_edges(links, pages), "late").collect()] == [("a", "x")]


def test_a_quota_is_kept_without_an_order_of_all(spark):
    frontier = spark.range(500).selectExpr("concat('/wiki/', id) AS path")
    taken = crawl._quota(frontier, 40)
    shown = taken._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in shown and "SinglePartition" not in shown and "GlobalLimit" not in shown
    assert 1 <= taken.count() <= 40 and crawl._quota(frontier, 1).count() == 1 and crawl._quota(frontier, 10**6).count() == 500


def test_a_running_recrawl_is_stopped(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}", buckets=2)
    known = TableSource(spark.createDataFrame(html(GRAPH), "name string, html string"))
    config = crawl.CrawlConfig(ttl_ms=0, factory=fixture_analyzer)
    crawl.crawl(store, known, spark.createDataFrame([("/wiki/1",)], "path string"), crawl.CrawlConfig(ttl_ms=0, factory=fixture_analyzer, max_generations=1))

    def stopping(frontier):
        again.stop()  # while the crawl of this cycle fetches
        return known(frontier)

    again = crawl.Recrawler(store, stopping, config, pause_s=0)
    before = store.read("visits").select("path").distinct().count()
    assert again.run() == 1 and again._crawler is None
    assert store.read("visits").select("path").distinct().count() < 7 and before == 1
    assert store.read("links").where("registered").count() == 0
