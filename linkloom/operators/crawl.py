"""The crawl as a loop of generations over a GraphStore.

A generation fetches its frontier, routes what came back, parses the documents,
works out creates, updates and tombstones, and admits the links that still point
nowhere. It looks up only what the generation touches and commits only what
changed, before the next one begins, so a crawl can be stopped, or lose its driver,
between any two and go on from the store.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from linkloom import schema
from linkloom.functions.html import DocumentAnalyzer, analyzer, parse_documents
from linkloom.functions.meter import TIMES
from linkloom.operators import changes, graph, report
from linkloom.operators.store import Delta, GraphStore
from linkloom.scratch import release, written
from linkloom.sources.fetch import Source


#: Created pages up to which one task numbers them, and about as many as a task numbers where there are more.
FEW = 10_000
#: Documents that a task analyses: files of alike documents are so small that a scan would leave tens of thousands to one task.
ANALYSED = 1000


#: How much larger rows are in memory than in the files of a crawl: paths are alike, so files hold them in a few bytes each.
UNPACKED = 20
FACTOR = "spark.sql.sources.fileCompressionFactor"


@contextmanager
def sized_rows(spark: SparkSession):
    """Within this block the session takes tables for as large as their rows are, not their files: what it broadcasts has to fit the driver."""
    had = spark.conf.get(FACTOR)
    spark.conf.set(FACTOR, str(float(UNPACKED)))
    try:
        yield
    finally:
        spark.conf.set(FACTOR, had)


@dataclass
class CrawlConfig:
    ttl_ms: int = schema.DEFAULT_TTL_MS
    #: Stop once so many pages were created or updated; below 0: never. Exact, in order of (generation, path).
    early_stop: int = -1
    #: Rows of a frontier that one generation takes at most; the rest waits. None: all of it.
    capacity: int | None = None
    #: Generations after which the crawl stops and says so; None: it goes on until nothing is due.
    max_generations: int | None = None
    #: Whether a page that comes back loses its tombstone.
    resurrect: bool = False
    #: After so many created pages ``on_publish`` gets them; 0: never.
    publish_every: int = 0
    on_publish: Callable[[DataFrame], None] | None = None
    factory: Callable[[], DocumentAnalyzer] = analyzer
    clock: Callable[[], int] = field(default=lambda: int(time.time() * 1000))


@dataclass
class CrawlReport:
    generations: int = 0
    #: Pages created or updated, unchanged ones included, and of these the created ones.
    indexed: int = 0
    created: int = 0
    gone: int = 0
    stashed: int = 0
    publishes: int = 0
    #: Why it ended: drained, early_stop, max_generations or stopped.
    ended: str = ""
    #: Of each generation the microseconds until all was fetched, all was analysed, and all was created and committed.
    stages: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def stopped_early(self) -> bool:
        return self.ended == "early_stop"


def admit(links: DataFrame, wanted: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """The wanted links that are due, with their states, registered."""
    state = changes.get_or_make_links(graph.pages_in(links, wanted), wanted)
    return state.where(changes.is_due(now_ms, ttl_ms)).withColumn("registered", F.lit(True))


def _fetch_times(fetched: DataFrame) -> DataFrame:
    """Fetched rows with what the source tells of its times as one column ``fetch``; null where it tells nothing."""
    told = all(c in fetched.columns for c in TIMES.names)
    return fetched.select("path", "html", "status", (F.struct(*TIMES.names) if told else F.lit(None).cast(TIMES)).alias("fetch"))


def _dealt(documents: DataFrame, n: int) -> DataFrame:
    """So many documents, dealt to tasks by path, ``ANALYSED`` to one as long as there are partitions for it."""
    tasks = min(n // ANALYSED, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return documents.repartition(tasks, "path") if tasks > 1 else documents


def _judged(store: GraphStore, good: DataFrame, paths: DataFrame | list) -> DataFrame:
    """Written rows of parsed pages with what the store says of each: action, changed, unique_id, is_removed, old_title."""
    pages = store.lookup("pages", paths)
    links = graph.neighbour_sets(store.lookup("edges", paths)).select(F.col("src").alias("path"), F.col("neighbours").alias("links"))
    judged = changes.page_changes(pages.join(links, "path", "left"), good)
    return written(judged.join(pages.select("path", "unique_id", "is_removed", F.col("title").alias("old_title")), "path", "left"), "judged")


def _page_rows(store: GraphStore, judged: DataFrame, gone: DataFrame, resurrect: bool, creates: int, next_id: int) -> DataFrame:
    """The pages that this generation writes: created (so many, with ids from ``next_id``), changed, tombstoned and, if asked for, brought back."""
    names = schema.PAGES.fieldNames()
    made = judged.where("action = 'create'").withColumn("is_removed", F.lit(False)).select(*names)
    if creates > FEW:
        made = graph.with_ids(made, next_id, creates // FEW + 1).select(*names)
    elif creates:  # so few that one task ranks them
        made = made.withColumn("unique_id", F.row_number().over(Window.orderBy("path")) - 1 + F.lit(next_id)).select(*names)
    back = F.col("is_removed") if resurrect else F.lit(False)
    kept = judged.where("action = 'update'").where(F.col("changed") | back)
    kept = kept.withColumn("is_removed", F.lit(False)) if resurrect else kept
    return made.unionByName(kept.select(*names)).unionByName(changes.tombstones(store.lookup("pages", gone), gone).select(*names))


def _resolved(store: GraphStore, judged: DataFrame, paths: DataFrame | list) -> DataFrame:
    """Written (src, dst, now, before, known, fresh): links that parsed pages state now or stated before.

    ``known``: the target has a page now; ``fresh``: the source is new or changed.
    """
    stated = judged.select(F.col("path").alias("src"), F.explode("links").alias("dst")).distinct().withColumn("now", F.lit(True))
    had = store.lookup("raw_links", paths).select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"), F.lit(True).alias("before")).distinct()
    both = stated.join(had, ["src", "dst"], "full")
    fresh = judged.select(F.col("path").alias("src"), (F.col("changed") | (F.col("action") == "create")).alias("fresh"))
    both = both.join(fresh, "src").select("src", "dst", F.coalesce("now", F.lit(False)).alias("now"), F.coalesce("before", F.lit(False)).alias("before"), "fresh")
    both = written(both, "links")
    # only the pages that links lead to are looked up
    known = store.lookup("pages", store.few(both.select("dst"))).select(F.col("path").alias("dst"))
    known = known.unionByName(judged.where("action = 'create'").select(F.col("path").alias("dst"))).withColumn("known", F.lit(True))
    out = written(both.join(known, "dst", "left").select(*both.columns, F.coalesce("known", F.lit(False)).alias("known")), "resolved")
    release(both)
    return out


def _late(store: GraphStore, judged: DataFrame, paths: DataFrame | list) -> DataFrame:
    """Edges of untouched pages that had been waiting for a page that is here now; the index of waiting links names them."""
    touched = judged.where("action = 'create' or changed").select(F.col("path").alias("src_path"))
    waiting = store.lookup("waiting", paths).join(touched, "src_path", "left_anti")
    return waiting.select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))


def _waiting(resolved: DataFrame, judged: DataFrame) -> Delta:
    """Links that begin or cease to wait; all of a page that is here now do so."""
    change = F.when(F.col("now") & ~F.col("before"), 1).when(F.col("before") & ~F.col("now"), -1).cast("long")
    moved = resolved.where("fresh and not known").select(F.col("dst").alias("dst_path"), F.col("src").alias("src_path"), change.alias("n"))
    return Delta(moved.where("n is not null"), judged.select(F.col("path").alias("dst_path")), adds=True)


def _titles(judged: DataFrame) -> Delta:
    """Titles of created pages; where a title changed, the new one comes and the old one goes."""
    made = judged.where(~F.col("title").eqNullSafe(F.col("old_title")))
    rows = made.select("title", "path", F.lit(1).cast("long").alias("n")).unionByName(made.select(F.col("old_title").alias("title"), "path", F.lit(-1).cast("long").alias("n")))
    return Delta(rows.where("title is not null"), adds=True)


def _early(parsed: DataFrame, left: int) -> DataFrame:
    """The first ``left`` good rows in order of path, and all others."""
    return written(parsed.where("route = 'index'").orderBy("path").limit(max(left, 0)).unionByName(parsed.where("route <> 'index'")), "parsed")


def _quota(frontier: DataFrame, capacity: int) -> DataFrame:
    """At most ``capacity`` rows: links are dealt to lanes by hash, and each lane takes its share in order of path.

    Lanes are sorted apart from each other, so no task sees the whole frontier. A lane
    that has less than its share leaves the rest of it unused; every lane takes one row
    at least, so what waits is reached in the end.
    """
    n = max(1, min(int(frontier.sparkSession.conf.get("spark.sql.shuffle.partitions")), capacity))
    lane = F.pmod(F.xxhash64("path"), F.lit(n))
    nth = F.row_number().over(Window.partitionBy("__lane").orderBy("path"))
    return frontier.withColumn("__lane", lane).withColumn("__nth", nth).where(F.col("__nth") <= capacity // n).drop("__lane", "__nth")


class Crawler:
    """One crawl: ``run`` it here, or ``start`` it beside the caller and ``stop`` it between two generations."""

    def __init__(self, store: GraphStore, source: Source, config: CrawlConfig | None = None):
        self.store, self.source, self.config = store, source, config or CrawlConfig()
        self.report = CrawlReport()
        self._stop, self._thread, self._error = threading.Event(), None, None

    @property
    def running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def start(self, seeds: DataFrame) -> None:
        def work():
            try:
                self.run(seeds)
            except Exception as e:  # noqa: BLE001  wait() raises it where the caller is
                self._error = e

        self._thread = threading.Thread(target=work, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        """Ends the crawl after the generation that runs; what waits is free again."""
        self._stop.set()

    def wait(self) -> CrawlReport:
        if self._thread is not None:
            self._thread.join()
        if self._error is not None:
            raise self._error
        return self.report

    def run(self, seeds: DataFrame) -> CrawlReport:
        """Generations from ``seeds`` (column path) until nothing is due, or something stops it.

        Seeds are fetched whatever their state; later links only when they are due.
        """
        with sized_rows(self.store.spark):
            return self._run(seeds)

    def _run(self, seeds: DataFrame) -> CrawlReport:
        store, config, done = self.store, self.config, self.report
        unpublished = 0
        self._next_id = store.read("pages").agg(F.coalesce(F.max("unique_id"), F.lit(-1))).first()[0] + 1
        frontier = written(changes.get_or_make_links(store.lookup("links", seeds.select("path")), seeds), "frontier")
        while True:
            if self._stop.is_set():
                done.ended = "stopped"
            elif config.max_generations is not None and done.generations >= config.max_generations:
                done.ended = "max_generations"
            if done.ended:
                break
            taken, waiting = frontier, None
            if config.capacity is not None:
                taken = written(_quota(frontier, config.capacity), "taken")
                waiting = frontier.join(taken.select("path"), "path", "left_anti")
            created, n_ahead, frontier = self._generation(taken, waiting, frontier)
            unpublished += created
            if config.publish_every and unpublished >= config.publish_every:
                self._publish()
                unpublished = 0
            if 0 <= config.early_stop <= done.indexed:
                done.ended = "early_stop"
            elif not n_ahead:
                done.ended = "drained"
        if done.ended != "drained":  # what still waits is free again
            store.commit(links=frontier.withColumn("registered", F.lit(False)))
        release(frontier)
        return done

    def _publish(self) -> None:
        done = self.report
        done.publishes += 1
        if self.config.on_publish is not None:
            last = getattr(self, "_published", -1)
            visits = self.store.read("visits").where((F.col("action") == "create") & (F.col("generation") > last))
            self.config.on_publish(self.store.lookup("pages", visits.select("path")))
        self._published = done.generations - 1

    def _generation(self, taken: DataFrame, waiting: DataFrame | None, frontier: DataFrame) -> tuple[int, int, DataFrame]:
        """One generation, committed: how many pages it created, and the next frontier with its size."""
        store, config, done = self.store, self.config, self.report
        marks = [time.perf_counter_ns()]
        n_documents = Observation()
        fetches = changes.fetch_routes(_fetch_times(self.source(taken)))
        routed = written(fetches.observe(n_documents, F.count(F.when(F.expr("route = 'parse'"), 1)).alias("n")), "fetched")
        marks.append(time.perf_counter_ns())
        parsed = written(parse_documents(_dealt(routed.where("route = 'parse'"), n_documents.get["n"]), config.factory), "parsed")
        marks.append(time.perf_counter_ns())
        used = [routed, parsed]
        if config.early_stop >= 0:
            parsed = _early(parsed, config.early_stop - done.indexed)
            used.append(parsed)
        good = parsed.where("route = 'index'").drop("error", "route")
        paths = store.few(good.select("path"))
        judged = _judged(store, good, paths)
        none = F.lit(None).cast("string")
        no_times = [F.lit(None).cast(f.dataType).alias(f.name) for f in TIMES]
        fetched = routed.where("route <> 'parse'").select("path", "route", F.col("status").alias("error"), none.alias("action"), *no_times, "fetch")
        bad = parsed.where("route <> 'index'").select("path", "route", "error", none.alias("action"), *TIMES.names, "fetch")
        action = F.when(F.col("changed") | (F.col("action") == "create"), F.col("action")).otherwise("unchanged")
        seen = judged.select("path", F.lit("index").alias("route"), none.alias("error"), action.alias("action"), *TIMES.names, "fetch")
        counted = Observation()
        n_of = lambda name, test: F.count(F.when(F.expr(test), 1)).alias(name)
        visits = fetched.unionByName(bad).unionByName(seen)
        visits = written(visits.observe(counted, n_of("created", "action = 'create'"), *[n_of(r, f"route = '{r}'") for r in ("index", "unlink", "stash")]), "visits")
        tally = counted.get
        gone = visits.where("route = 'unlink'").select("path")
        pages = _page_rows(store, judged, gone, config.resurrect, tally["created"], self._next_id)
        resolved = _resolved(store, judged, paths)
        now = config.clock()
        fresh = judged.where("changed or action = 'create'")
        edges = resolved.where("known and fresh and now").select("src", "dst").unionByName(_late(store, judged, paths))
        unknown = resolved.where("now and not known").select(F.col("dst").alias("path")).distinct()
        # states of what was visited; what early stop has cut is free again
        states = changes.mark_processed(taken, visits.select("path", (F.col("route") == "index").alias("page_found")), now)
        states = states.join(visits.select("path", F.lit(True).alias("__seen")), "path", "left")
        states = states.withColumn("registered", F.col("registered") & F.col("__seen").isNotNull()).drop("__seen")
        known = changes.upsert(store.lookup("links", unknown), states)
        admitted = admit(known, unknown, now, config.ttl_ms)
        if waiting is not None:
            admitted = admitted.join(waiting.select("path"), "path", "left_anti")
        n_admitted = Observation()
        admitted = written(admitted.observe(n_admitted, F.count("*").alias("n")), "admitted")
        n_ahead = n_admitted.get["n"]
        store.commit(
            pages=pages,
            urls=fresh.select("path", "locales"),
            titles=_titles(judged),
            waiting=_waiting(resolved, judged),
            raw_links=Delta(resolved.where("fresh and now").select(F.col("src").alias("src_path"), F.col("dst").alias("dst_path")), fresh.select(F.col("path").alias("src_path"))),
            edges=Delta(edges, fresh.select(F.col("path").alias("src"))),
            links=changes.upsert(states, admitted),
            visits=visits.select("path", F.lit(done.generations).cast("long").alias("generation"), "route", "error", "action", F.lit(now).cast("long").alias("at_ms"), F.col("worker").cast("long").alias("worker"), *TIMES.names[1:], "fetch"),
        )
        marks.append(time.perf_counter_ns())
        done.stages.append(tuple((b - a) // 1000 for a, b in zip(marks, marks[1:])))
        done.generations += 1
        self._next_id += tally["created"]
        done.created += tally["created"]
        done.indexed += tally["index"]
        done.gone += tally["unlink"]
        done.stashed += tally["stash"]
        ahead = admitted
        if waiting is not None:
            n_waiting = Observation()
            ahead = written(waiting.unionByName(admitted).observe(n_waiting, F.count("*").alias("n")), "frontier")
            n_ahead = n_waiting.get["n"]
            used += [admitted, taken]
        release(*used, judged, visits, resolved, frontier)
        return tally["created"], n_ahead, ahead


def crawl(store: GraphStore, source: Source, seeds: DataFrame, config: CrawlConfig | None = None) -> CrawlReport:
    """A crawl from start to end, in the caller's thread."""
    return Crawler(store, source, config).run(seeds)


def recrawl_due(store: GraphStore, now_ms: int, ttl_ms: int = schema.DEFAULT_TTL_MS) -> DataFrame:
    """Links whose last visit is longer ago than the ttl: seeds of the next crawl, each once."""
    stale = changes.stale_links(store.read("links"), now_ms - ttl_ms)
    return stale.where(changes.is_due(now_ms, ttl_ms)).select("path").distinct()


class Recrawler:
    """Visits links again as they fall due, until it is stopped."""

    def __init__(self, store: GraphStore, source: Source, config: CrawlConfig | None = None, pause_s: float = 1.0):
        self.store, self.source, self.config, self.pause_s = store, source, config or CrawlConfig(), pause_s
        self._stop, self.cycles = threading.Event(), 0
        self._crawler: Crawler | None = None

    def stop(self) -> None:
        """Ends the loop, and a crawl that runs after its generation."""
        self._stop.set()
        if (crawler := self._crawler) is not None:
            crawler.stop()

    def run(self, cycles: int | None = None) -> int:
        """Cycles until ``stop``, or so many; a cycle with nothing due waits. Returns how many crawls ran."""
        ran = 0
        while not self._stop.is_set() and (cycles is None or self.cycles < cycles):
            self.cycles += 1
            seeds = written(recrawl_due(self.store, self.config.clock(), self.config.ttl_ms), "due")
            if seeds.isEmpty():
                self._stop.wait(self.pause_s)
            else:
                self._crawler = Crawler(self.store, self.source, self.config)
                if self._stop.is_set():  # stopped before there was a crawl to stop
                    self._crawler.stop()
                self._crawler.run(seeds)
                self._crawler = None
                ran += 1
            release(seeds)
        return ran


def worker_report(store: GraphStore) -> DataFrame:
    """Documents, total and mean microseconds of analysis for each task that parsed, and for all of them."""
    return report.worker_report(store.read("visits").where("worker is not null"), "worker", "took_us")


def consumer_report(store: GraphStore) -> DataFrame:
    """Of each task number that analysed, and of all in a row named Total: documents consumed, pages created, and totals and means of its times."""
    log = store.read("visits").where("worker is not null")
    return report.time_report(log, "worker", TIMES.names[1:], consumed=F.lit(True), created=F.col("action") == "create")


def producer_report(store: GraphStore) -> DataFrame:
    """The same of each task number that fetched: links fetched, documents placed for analysis. Only sources that are ``timed`` have rows."""
    log = store.read("visits").where("fetch is not null")
    log = log.select("worker", *[F.col(f"fetch.{n}").alias(f"f_{n}" if n == "worker" else n) for n in TIMES.names])
    return report.time_report(log, "f_worker", TIMES.names[1:], fetched=F.lit(True), placed=F.col("worker").isNotNull())


def counters(store: GraphStore) -> DataFrame:
    """Visits of each route and action, over all crawls that the store has seen."""
    return store.read("visits").groupBy("route", "action").agg(F.count("*").alias("n"))
