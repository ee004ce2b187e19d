"""Queries through the crawl engine: a page per part, which states the edges of the part graph as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.html import fixture_analyzer
from linkloom.operators import crawl
from linkloom.operators.services import Pages
from linkloom.operators.store import GraphStore
from linkloom.plans.graph_queries import _EDGES, line_steps
from linkloom.plans.registry import query
from linkloom.scratch import new_path, written
from linkloom.sources import fetch, fixtures
from linkloom.sources.tables import table

#: Parts with p_size divisible by 7 do not exist, those by 11 cannot be reached just now.
_STATUS = "CASE WHEN p_size % 7 = 0 THEN 'DOES_NOT_EXIST' WHEN p_size % 11 = 0 THEN 'CONNECTION_ERROR' ELSE 'SUCCESS' END"
_CRAWL = f"""WITH RECURSIVE {_EDGES}, s AS (SELECT p_partkey AS v, p_name AS title, {_STATUS} AS status FROM part),
  good AS (SELECT src, dst FROM e JOIN s ON s.v = src WHERE status = 'SUCCESS'),
  walk AS (SELECT (SELECT min(v) FROM s WHERE status = 'SUCCESS') AS v, 0 AS g UNION SELECT dst, g + 1 FROM walk JOIN good ON src = v WHERE g < 10),
  seen AS (SELECT v, min(g) AS generation FROM walk GROUP BY v), c AS (SELECT * FROM seen JOIN s USING (v))"""
#: The first crawl of two finds every page.
_ALL = f"""WITH RECURSIVE {_EDGES}, s AS (SELECT p_partkey AS v, p_name AS title, {_STATUS} AS status FROM part),
  walk AS (SELECT (SELECT min(v) FROM s WHERE status = 'SUCCESS') AS v, 0 AS g UNION SELECT dst, g + 1 FROM walk JOIN e ON src = v WHERE g < 10),
  c AS (SELECT DISTINCT v, title, status FROM walk JOIN s USING (v))"""
#: A crawl over files: parts with p_size divisible by 7 have none.
_STATUS_FILES = "CASE WHEN p_size % 7 = 0 THEN 'DOES_NOT_EXIST' ELSE 'SUCCESS' END"
_CRAWL_FILES = _CRAWL.replace(_STATUS, _STATUS_FILES)
TTL = 1_000


class _Clock:
    """Moves by ten milliseconds each time it is asked; no wall clock."""

    def __init__(self, now: int = 10_000):
        self.now = now

    def __call__(self) -> int:
        self.now += 10
        return self.now


def part_path(key) -> F.Column:
    """Paths in the order of their keys."""
    return F.concat(F.lit("/wiki/"), F.lpad(key.cast("string"), 12, "0"))


def _key(path: str = "path") -> F.Column:
    return F.regexp_extract(path, "([0-9]+)$", 1).cast("long")


def recorded(spark, sf_dir: str) -> DataFrame:
    """Written fetches (path, html, status) of all parts; html is there whatever the status."""
    # a page's links are a set, so lines meet by source at once, and edges are not freed of repeats by a shuffle of their own
    out = line_steps(spark, sf_dir).repartition("src").groupBy("src").agg(F.transform(F.array_sort(F.collect_set("dst")), part_path).alias("links"))
    part = table(spark, sf_dir, "part").join(out, F.col("p_partkey") == F.col("src"), "left")
    html = fixtures.fixture_text(F.col("p_name"), F.lit(None).cast("string"), F.coalesce("links", F.array().cast("array<string>")))
    return written(part.select(part_path(F.col("p_partkey")).alias("path"), html.alias("html"), F.expr(_STATUS).alias("status"), "p_size"), "recorded")


def _seed(fetches: DataFrame) -> DataFrame:
    return fetches.where("status = 'SUCCESS'").agg(F.min("path").alias("path"))


_runs: dict[tuple, tuple[GraphStore, crawl.CrawlReport, list]] = {}


def crawled(spark, sf_dir: str, kind: str = "whole") -> tuple[GraphStore, crawl.CrawlReport, list]:
    """One crawl of the part graph; several queries read the store it leaves, so each kind runs once in a session."""
    name = (spark.sparkContext.applicationId, sf_dir, kind)
    if name not in _runs:
        fetches, published = recorded(spark, sf_dir), []
        store = GraphStore(spark, new_path(spark, "crawl"))
        config = crawl.CrawlConfig(ttl_ms=TTL, factory=fixture_analyzer, clock=_Clock(), publish_every=1, on_publish=lambda pages: published.append(pages.count()))
        if kind == "early":
            config.early_stop = 50
        if kind == "narrow":
            config.capacity = max(1, fetches.count() // 4)
        source = fetch.RecordedSource(fetches.withColumn("status", F.lit("SUCCESS")) if kind == "twice" else fetches)
        report = crawl.crawl(store, source, _seed(fetches), config)
        if kind == "twice":
            # once all links are due again, the real statuses show; what is gone loses its page's life, not its edges
            config.clock.now += 10 * TTL
            again = crawl.Recrawler(store, fetch.RecordedSource(fetches), config, pause_s=0)
            again.run(cycles=1)
        _runs[name] = store, report, published
    return _runs[name]


@query("crawl_generations", f"{_CRAWL} SELECT v, CAST(generation AS BIGINT) AS generation, status FROM c")
def crawl_generations(spark, sf_dir):
    """The crawl's log: each link once, in the generation in which it was found."""
    store, _, _ = crawled(spark, sf_dir)
    status = F.when(F.col("route") == "index", "SUCCESS").otherwise(F.col("error"))
    return store.read("visits").select(_key().alias("v"), "generation", status.alias("status"))


@query("crawl_early_stop", f"{_CRAWL} SELECT v, CAST(generation AS BIGINT) AS generation FROM c WHERE status = 'SUCCESS' ORDER BY generation, v LIMIT 50")
def crawl_early_stop(spark, sf_dir):
    """The stop condition is the feature: 50 pages, the first in order of generation and path."""
    store, _, _ = crawled(spark, sf_dir, "early")
    return store.read("visits").where("route = 'index'").select(_key().alias("v"), "generation")


@query("crawl_early_stop_states", "SELECT CAST(0 AS BIGINT) AS registered, CAST(50 AS BIGINT) AS pages, 'early_stop' AS ended")
def crawl_early_stop_states(spark, sf_dir):
    """After an early stop nothing waits: what was taken or queued is free again."""
    store, report, _ = crawled(spark, sf_dir, "early")
    counts = store.read("links").agg(F.count(F.when(F.col("registered"), 1)).alias("registered"))
    return counts.crossJoin(store.read("pages").agg(F.count("*").alias("pages"))).withColumn("ended", F.lit(report.ended))


@query("crawl_pages", f"{_CRAWL} SELECT v, title, CAST(row_number() OVER (ORDER BY generation, v) - 1 AS BIGINT) AS unique_id FROM c WHERE status = 'SUCCESS'")
def crawl_pages(spark, sf_dir):
    """Created pages; ids are dense, in order of generation and path."""
    store, _, _ = crawled(spark, sf_dir)
    return store.read("pages").select(_key().alias("v"), "title", "unique_id")


@query("crawl_narrow_pages", f"{_CRAWL} SELECT v, title FROM c WHERE status = 'SUCCESS'")
def crawl_narrow_pages(spark, sf_dir):
    """A bound on what a generation takes changes the order, not the pages."""
    store, _, _ = crawled(spark, sf_dir, "narrow")
    return store.read("pages").select(_key().alias("v"), "title")


@query("crawl_edges", f"{_CRAWL} SELECT src, dst FROM good JOIN c a ON a.v = src JOIN c b ON b.v = dst WHERE b.status = 'SUCCESS'")
def crawl_edges(spark, sf_dir):
    """Edges between pages that were found, links that waited for their page included."""
    store, _, _ = crawled(spark, sf_dir)
    return store.read("edges").select(_key("src").alias("src"), _key("dst").alias("dst"))


@query("crawl_dangling", f"{_CRAWL} SELECT dst, count(*) AS n FROM good JOIN c a ON a.v = src WHERE dst NOT IN (SELECT v FROM c WHERE status = 'SUCCESS') GROUP BY dst")
def crawl_dangling(spark, sf_dir):
    """How many pages wait for each path without a page, by the index that the crawl has kept up."""
    store, _, _ = crawled(spark, sf_dir)
    return Pages(store).pending().select(_key("dst_path").alias("dst"), F.size("sources").cast("long").alias("n"))


@query("crawl_states", f"{_CRAWL} SELECT v, true AS processed, false AS registered, status = 'SUCCESS' AS page_found, true AS was_visited FROM c")
def crawl_states(spark, sf_dir):
    """Link states after the crawl."""
    store, _, _ = crawled(spark, sf_dir)
    return store.read("links").select(_key().alias("v"), "processed", "registered", "page_found", (F.col("last_processed_ms") > 0).alias("was_visited"))


@query("crawl_urls", f"{_CRAWL} SELECT v, 'en:/wiki/' || lpad(CAST(v AS VARCHAR), 12, '0') AS locales FROM c WHERE status = 'SUCCESS'")
def crawl_urls(spark, sf_dir):
    """The links' paths by language, as the crawl has written them."""
    from linkloom.functions.links import encode_locales

    store, _, _ = crawled(spark, sf_dir)
    return store.read("urls").select(_key().alias("v"), F.array_join(encode_locales(F.col("locales")), ",").alias("locales"))


@query("retry_classes", f"{_CRAWL} SELECT CASE status WHEN 'SUCCESS' THEN 'index' WHEN 'DOES_NOT_EXIST' THEN 'unlink' ELSE 'stash' END AS route, count(*) AS n FROM c GROUP BY ALL")
def retry_classes(spark, sf_dir):
    store, _, _ = crawled(spark, sf_dir)
    return store.read("visits").groupBy("route").agg(F.count("*").alias("n"))


@query(
    "crawl_counters",
    f"""{_CRAWL} SELECT CAST(max(generation) + 1 AS BIGINT) AS generations, count(*) FILTER (WHERE status = 'SUCCESS') AS indexed, count(*) FILTER (WHERE status = 'DOES_NOT_EXIST') AS gone,
    count(*) FILTER (WHERE status = 'CONNECTION_ERROR') AS stashed, count(DISTINCT generation) FILTER (WHERE status = 'SUCCESS') AS publishes, 'drained' AS ended FROM c""",
)
def crawl_counters(spark, sf_dir):
    """The crawl's own counts; it publishes after each generation that created a page."""
    _, report, _ = crawled(spark, sf_dir)
    row = (report.generations, report.indexed, report.gone, report.stashed, report.publishes, report.ended)
    return spark.createDataFrame([row], "generations long, indexed long, gone long, stashed long, publishes long, ended string")


@query(
    "crawl_publishes",
    f"{_CRAWL} SELECT CAST(row_number() OVER (ORDER BY generation) - 1 AS BIGINT) AS publish, count(*) AS pages FROM c WHERE status = 'SUCCESS' GROUP BY generation",
)
def crawl_publishes(spark, sf_dir):
    """Pages that each publication hands over: those created since the one before."""
    _, _, published = crawled(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(published)), "publish long, pages long")


@query("crawl_workers", f"{_CRAWL} SELECT 'Total' AS worker, count(*) AS items FROM c WHERE status = 'SUCCESS'")
def crawl_workers(spark, sf_dir):
    """Documents analysed by all workers together; times are not the same in two runs."""
    store, _, _ = crawled(spark, sf_dir)
    return crawl.worker_report(store).where("worker = 'Total' and total >= 0").select("worker", "items")


@query(
    "crawl_worker_times",
    f"""{_CRAWL_FILES} SELECT 'producers' AS kind, count(*) AS items, count(*) FILTER (status = 'SUCCESS') AS made, true AS timed FROM c
    UNION ALL SELECT 'consumers', count(*), count(*), true FROM c WHERE status = 'SUCCESS'""",
)
def crawl_worker_times(spark, sf_dir):
    """A crawl over files: what all producers fetched and placed, what all consumers analysed and created.

    ``timed``: there are times of work, starvation and blocking, and the totals are the sums over workers.
    """
    name = F.regexp_replace("path", "^/wiki/", "")
    folder = new_path(spark, "pages")
    found = recorded(spark, sf_dir).withColumn("status", F.expr(_STATUS_FILES))
    fixtures.write_pages(found.where("status = 'SUCCESS'").select(name.alias("name"), "html"), folder)
    store = GraphStore(spark, new_path(spark, "crawl"))
    crawl.crawl(store, fetch.FileSource(folder, timed=True), _seed(found), crawl.CrawlConfig(ttl_ms=TTL, factory=fixture_analyzer, clock=_Clock()))
    return _totals(crawl.producer_report(store), "producers", "fetched", "placed").unionByName(_totals(crawl.consumer_report(store), "consumers", "consumed", "created"))


def _totals(times: DataFrame, kind: str, items: str, made: str) -> DataFrame:
    """One row of a report: the counts of its Total, and whether its times are those of all workers."""
    names = ("took_us", "starved_us", "blocked_us")
    whole = F.col("worker") == "Total"
    rows = times.agg(
        *[F.sum(F.when(whole, F.col(c))).alias(n) for c, n in ((items, "items"), (made, "made"))],
        F.bool_and(F.expr(" AND ".join(f"{n} >= 0" for n in names))).alias("there"),
        *[F.sum(F.when(whole, F.col(n)).otherwise(-F.col(n))).alias(n) for n in names],
        F.sum(F.when(whole, F.col("took_us") * F.col("starved_us"))).alias("some"),
    )
    sums = F.expr(" AND ".join(f"{n} = 0" for n in names))
    return rows.select(F.lit(kind).alias("kind"), "items", "made", (F.col("there") & sums & (F.col("some") > 0)).alias("timed"))


@query("tombstones", f"{_ALL} SELECT v, status = 'DOES_NOT_EXIST' AS is_removed FROM c")
def tombstones(spark, sf_dir):
    """A second crawl of all links finds some pages gone."""
    store, _, _ = crawled(spark, sf_dir, "twice")
    return store.read("pages").select(_key().alias("v"), "is_removed")


@query("tombstone_edges", f"{_ALL} SELECT src, dst FROM e JOIN c ON v = src")
def tombstone_edges(spark, sf_dir):
    """Edges of removed pages stay."""
    store, _, _ = crawled(spark, sf_dir, "twice")
    return store.read("edges").select(_key("src").alias("src"), _key("dst").alias("dst"))


@query(
    "recrawl_actions",
    f"""{_ALL} SELECT 'index' AS route, 'create' AS action, count(*) AS n FROM c UNION ALL
    SELECT CASE status WHEN 'SUCCESS' THEN 'index' WHEN 'DOES_NOT_EXIST' THEN 'unlink' ELSE 'stash' END, CASE WHEN status = 'SUCCESS' THEN 'unchanged' END, count(*) FROM c GROUP BY ALL""",
)
def recrawl_actions(spark, sf_dir):
    """Both crawls by what they did: pages that say the same are visited, and not written."""
    store, _, _ = crawled(spark, sf_dir, "twice")
    return crawl.counters(store)


@query("recrawl_not_due", "SELECT '' AS path WHERE false")
def recrawl_not_due(spark, sf_dir):
    """Right after a crawl nothing is due."""
    store, _, _ = crawled(spark, sf_dir)
    now = store.read("visits").agg(F.max("at_ms")).first()[0]
    return crawl.recrawl_due(store, now, TTL)


@query("recrawl_due", f"{_CRAWL} SELECT v FROM c")
def recrawl_due(spark, sf_dir):
    """Once the ttl is over, everything is."""
    store, _, _ = crawled(spark, sf_dir)
    now = store.read("visits").agg(F.max("at_ms")).first()[0]
    return crawl.recrawl_due(store, now + TTL + 1, TTL).select(_key().alias("v"))
