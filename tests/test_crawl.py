import copy
import io

from fixtures import GRAPH, html
from pyspark.sql import functions as F

from linkloom import cli, schema
from linkloom.functions.html import fixture_analyzer
from linkloom.functions.meter import metered
from linkloom.operators import changes, crawl
from linkloom.operators.store import GraphStore
from linkloom.sources import fetch, fixtures
from linkloom.sources.fetch import ScriptedSource, TableSource
from linkloom.streaming import admission


def source(spark, graph):
    return TableSource(spark.createDataFrame(html(graph), "name string, html string"))


def seeds(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


class Clock:
    def __init__(self, now=10_000):
        self.now = now

    def __call__(self):
        self.now += 10
        return self.now


def edges(store):
    return {(r.src[6:], r.dst[6:]) for r in store.read("edges").collect()}


def test_two_phases(spark, tmp_path):
    store, clock = GraphStore(spark, f"file://{tmp_path}"), Clock()
    config = crawl.CrawlConfig(ttl_ms=0, factory=fixture_analyzer, clock=clock)
    graph = copy.deepcopy(GRAPH)
    graph["5"][2].append("8")
    report = crawl.crawl(store, source(spark, graph), seeds(spark, "/wiki/1"), config)
    base = {(a, b) for a, v in GRAPH.items() for b in v[2]}
    assert edges(store) == base and report.indexed == 7 and report.gone == 1
    assert store.read("raw_links").where("dst_path = '/wiki/8'").count() == 1
    ids = [r.unique_id for r in store.read("pages").collect()]
    assert sorted(ids) == list(range(7))

    graph["1"] = ("Title1", "where the walk begins", ["2", "7", "8"])
    graph["8"] = ("8", "eight", ["9", "2"])
    report = crawl.crawl(store, source(spark, graph), seeds(spark, "/wiki/1"), config)
    assert report.generations == 3  # 1, then 8, then 9
    assert edges(store) == base - {("1", "3")} | {("1", "8"), ("5", "8"), ("8", "2")}
    titles = {r.title: r.path for r in store.read("pages").collect()}
    assert titles["Title1"] == "/wiki/1" and "1" not in titles
    assert sorted(r.unique_id for r in store.read("pages").collect()) == list(range(8))
    assert store.read("links").where("registered").count() == 0

    # a page that is gone becomes a tombstone and stays one
    del graph["8"]
    crawl.crawl(store, source(spark, graph), seeds(spark, "/wiki/8"), config)
    assert store.read("pages").where("path = '/wiki/8'").first().is_removed
    graph["8"] = ("8", "eight", ["9", "2"])
    crawl.crawl(store, source(spark, graph), seeds(spark, "/wiki/8"), config)
    assert store.read("pages").where("path = '/wiki/8'").first().is_removed
    config.resurrect = True  # the page is unchanged, and comes back all the same
    crawl.crawl(store, source(spark, graph), seeds(spark, "/wiki/8"), config)
    assert not store.read("pages").where("path = '/wiki/8'").first().is_removed
    store.vacuum(keep=1)
    assert store.read("pages").count() == 8


def test_early_stop_stash_and_ttl(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/a")
    config = crawl.CrawlConfig(ttl_ms=5, early_stop=3, factory=fixture_analyzer, clock=Clock(), capacity=2)
    report = crawl.crawl(store, source(spark, GRAPH), seeds(spark, "/wiki/1"), config)
    assert report.stopped_early and report.indexed == 3 and store.read("pages").count() == 3
    assert store.read("links").where("registered").count() == 0

    store = GraphStore(spark, f"file://{tmp_path}/b")
    flaky = ScriptedSource(source(spark, GRAPH), F.when(F.col("path") == "/wiki/3", schema.CONNECTION_ERROR))
    config = crawl.CrawlConfig(ttl_ms=1000, factory=fixture_analyzer, clock=Clock())
    report = crawl.crawl(store, flaky, seeds(spark, "/wiki/1"), config)
    assert report.stashed == 1 and store.read("pages").count() == 4
    state = store.read("links").where("path = '/wiki/3'").first()
    assert state.processed and not state.page_found
    assert crawl.recrawl_due(store, 10_500, 1000).count() == 0
    assert crawl.recrawl_due(store, 15_000, 1000).count() == 5


def test_early_stop_frees_what_it_cuts(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}")
    config = crawl.CrawlConfig(ttl_ms=0, early_stop=3, factory=fixture_analyzer, clock=Clock())
    report = crawl.crawl(store, source(spark, GRAPH), seeds(spark, "/wiki/1"), config)
    assert report.ended == "early_stop" and report.indexed == 3
    assert store.read("links").where("registered").count() == 0
    config.early_stop = -1
    crawl.crawl(store, source(spark, GRAPH), seeds(spark, "/wiki/7"), config)
    assert {r.path for r in store.read("pages").collect()} == {f"/wiki/{k}" for k in (1, 2, 3, 7, 6)}


def test_a_generation_limit_is_reported(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}")
    config = crawl.CrawlConfig(ttl_ms=0, max_generations=2, factory=fixture_analyzer, clock=Clock())
    report = crawl.crawl(store, source(spark, GRAPH), seeds(spark, "/wiki/1"), config)
    assert report.ended == "max_generations" and report.generations == 2 and store.read("links").where("registered").count() == 0


def test_unexpected_errors_are_stashed(spark, tmp_path):
    def factory():
        analyze = fixture_analyzer()

        def careful(path, markup):
            if path == "/wiki/3":
                raise RuntimeError("no memory")
            return analyze(path, markup)

        return careful

    store = GraphStore(spark, f"file://{tmp_path}")
    config = crawl.CrawlConfig(ttl_ms=1000, factory=factory, clock=Clock())
    report = crawl.crawl(store, source(spark, GRAPH), seeds(spark, "/wiki/1"), config)
    assert report.stashed == 1 and report.gone == 0 and report.indexed == 4
    state = store.read("links").where("path = '/wiki/3'").first()
    assert state.processed and not state.registered and not state.page_found
    assert store.read("pages").where("is_removed").count() == 0


def test_publishing_stopping_and_visiting_again(spark, tmp_path):
    store, batches = GraphStore(spark, f"file://{tmp_path}"), []
    config = crawl.CrawlConfig(ttl_ms=15, factory=fixture_analyzer, clock=Clock(), publish_every=3, on_publish=lambda p: batches.append({r.path[6:] for r in p.collect()}))
    report = crawl.crawl(store, source(spark, GRAPH), seeds(spark, "/wiki/1"), config)
    assert report.publishes == 2 and batches == [{"1", "2", "3", "7"}, {"4", "5", "6"}]
    totals = {r.worker: r for r in crawl.worker_report(store).collect()}
    assert totals["Total"].items == 7 and totals["Total"].total >= 0
    assert {(r.route, r.action): r.n for r in crawl.counters(store).collect()} == {("index", "create"): 7}
    again = crawl.Recrawler(store, source(spark, GRAPH), config, pause_s=0)
    assert again.run(cycles=1) == 1
    assert {(r.route, r.action): r.n for r in crawl.counters(store).collect()}[("index", "unchanged")] >= 1
    again.stop()
    assert again.run() == 0
    stopped = crawl.Crawler(store, source(spark, GRAPH), config)
    stopped.stop()
    stopped.start(seeds(spark, "/wiki/1"))
    assert stopped.wait().ended == "stopped" and not stopped.running


def test_documents_are_analysed_by_several_tasks(spark, tmp_path, monkeypatch):
    """Documents of one small file are dealt to tasks by their number."""
    monkeypatch.setattr(crawl, "ANALYSED", 4, raising=False)
    graph = {"1": ("1", "", [str(k) for k in range(2, 42)])} | {str(k): (str(k), "", ["1"]) for k in range(2, 42)}
    pages = spark.createDataFrame(html(graph), "name string, html string").coalesce(1)
    store = GraphStore(spark, f"file://{tmp_path}")
    crawl.crawl(store, TableSource(pages), seeds(spark, "/wiki/1"), crawl.CrawlConfig(ttl_ms=1000, factory=fixture_analyzer, clock=Clock()))
    assert store.read("visits").where("generation = 1").select("worker").distinct().count() > 1
    assert len(edges(store)) == 80 and store.read("pages").count() == 41


def test_times_of_producers_and_consumers(spark, tmp_path):
    """A crawl over files written by tasks: what each worker did, and how long it worked, starved and was blocked."""
    folder = f"file://{tmp_path}/pages"
    pages = html({k: v for k, v in GRAPH.items() if k != "5"})
    fixtures.write_pages(spark.createDataFrame([*pages, ("empty", None)], "name string, html string"), folder)
    assert {r.name: r.html for r in fetch.text_files(spark, folder).collect()} == dict(pages)  # Spark reads no row from an empty file
    store = GraphStore(spark, f"file://{tmp_path}/store", buckets=2)
    config = crawl.CrawlConfig(ttl_ms=1000, factory=fixture_analyzer, clock=Clock())
    done = crawl.crawl(store, fetch.FileSource(folder, timed=True), seeds(spark, "/wiki/1"), config)
    assert (done.created, done.gone) == (6, 1) and len(done.stages) == done.generations and all(len(s) == 3 and min(s) > 0 for s in done.stages)
    for rows, items, made in ((crawl.producer_report(store), ("fetched", 7), ("placed", 6)), (crawl.consumer_report(store), ("consumed", 6), ("created", 6))):
        workers = {r.worker: r for r in rows.collect()}
        whole = workers.pop("Total")
        assert (whole[items[0]], whole[made[0]]) == (items[1], made[1])
        for n in ("took_us", "starved_us", "blocked_us"):
            assert whole[n] == sum(w[n] for w in workers.values()) >= 0
            assert abs(whole[f"mean_{n}"] * items[1] - whole[n]) < 1e-3
        assert whole.took_us > 0 and whole.starved_us > 0
    # a source that tells no times has no producers
    config.max_generations = 1
    crawl.crawl(again := GraphStore(spark, f"file://{tmp_path}/again", buckets=2), source(spark, GRAPH), seeds(spark, "/wiki/1"), config)
    assert crawl.producer_report(again).count() == 0 and crawl.consumer_report(again).where("worker = 'Total'").first().consumed == 1


def test_waits_are_borne_by_rows():
    """The first row of a batch bears the wait for it, the last one the time until the others were taken."""
    import time

    import pyarrow as pa

    def coming():
        for k in (3, 0, 1):
            time.sleep(0.05)
            yield pa.record_batch([pa.array(range(k), pa.int64())], names=["x"])

    rows = []
    for out in metered(coming(), lambda b: b):
        rows += out.to_pylist()
        time.sleep(0.03)
    assert [r["x"] for r in rows] == [0, 1, 2, 0]
    assert [r["starved_us"] >= 50_000 for r in rows] == [True, False, False, True] and rows[1]["starved_us"] == rows[2]["starved_us"] == 0
    assert rows[3]["starved_us"] >= 100_000  # the empty batch's wait too
    assert [r["blocked_us"] >= 30_000 for r in rows] == [False, False, True, False]


def test_store_merges_deltas(spark, tmp_path):
    from linkloom.operators.services import Links, Pages
    from linkloom.operators.store import Delta

    store = GraphStore(spark, f"file://{tmp_path}", parts=3)
    page = lambda k, t: (k, int(k[1:]), t, "", False, "", False, {})
    want = {}
    for n in range(9):
        rows = [page(f"p{k}", f"t{n}") for k in range(n, n + 4)]
        want |= {r[0]: r[2] for r in rows}
        store.commit(pages=spark.createDataFrame(rows, schema.PAGES), edges=Delta(spark.createDataFrame([(f"p{n}", f"p{k}") for k in range(n % 3)], schema.EDGES), spark.createDataFrame([(f"p{max(n - 1, 0)}",)], "src string")))
        assert {r.path: r.title for r in store.read("pages").collect()} == want
    # each commit clears the edges of the page before
    assert {(r.src, r.dst) for r in store.read("edges").collect()} == {("p8", "p0"), ("p8", "p1")}
    assert all(len(parts) <= 4 for parts in store._manifest().values())
    store.vacuum(keep=1)
    assert {r.path: r.title for r in store.read("pages").collect()} == want

    pages, links = Pages(store), Links(store, ttl_ms=50)
    assert pages.next_id() == 12 and pages.count() == 12 and pages.by_id(3).first().title == "t3" and pages.by_title("t8").count() == 4
    pages.create_bare(spark.createDataFrame([page("p1", "no"), page("p20", "new")], schema.PAGES))
    assert pages.by_path("p1").first().title == "t1" and pages.by_path("p20").first().title == "new"
    pages.save(spark.createDataFrame([("p1", "saved", None), ("p99", "x", "y")], "path string, title string, description string"))
    assert pages.by_path("p1").first().title == "saved" and pages.by_path("p99").count() == 0 and pages.count() == 13
    assert {r.path for r in pages.neighbours("p8").collect()} == {"p0", "p1"}
    pages.clear_out_edges(spark.createDataFrame([("p8",)], "path string"))
    assert pages.neighbours("p8").count() == 0
    asked = spark.createDataFrame([("a",), ("b",)], "path string")
    links.create(asked)
    links.update(links.by_path("a").withColumn("last_processed_ms", F.lit(100).cast("long")))
    assert {r.path: r.due for r in links.due(spark.createDataFrame([("a",), ("b",), ("c",)], "path string"), 120).collect()} == {"a": False, "b": True, "c": True}
    assert links.count() == 2 and links.by_path("c").count() == 0 and {r.path for r in links.before(100).collect()} == {"b"}
    links.delete(spark.createDataFrame([("a",)], "path string"))
    assert links.count() == 1 and links.by_path("a").count() == 0
    links.put_urls(spark.createDataFrame([("a", {"en": "a"})], schema.URLS))
    links.put_urls(spark.createDataFrame([("a", {"de": "b"})], schema.URLS))
    assert links.urls().first().locales == {"de": "b"}


def test_publish_drains_staging(spark, tmp_path):
    store, seen = GraphStore(spark, f"file://{tmp_path}"), []
    rows = spark.createDataFrame([("a", "b")], schema.EDGES)
    for _ in range(2):
        store.publish({"edges": rows}, lambda staged: seen.append(staged["edges"].count()))
    assert seen == [1, 1] and store.read("edges").count() == 1


def test_link_states(spark):
    rows = [("a", False, -1), ("b", True, -1), ("c", False, 100_000), ("d", False, 99_999), ("e", False, 150_000)]
    links = spark.createDataFrame([(p, p, False, r, False, t) for p, r, t in rows], schema.LINKS)
    due = {r.path: r.due for r in links.select("path", changes.is_due(200_000, 100_000).alias("due")).collect()}
    assert due == {"a": True, "b": False, "c": False, "d": True, "e": False}
    assert {r.path for r in changes.stale_links(links, 100_000).collect()} == {"a", "b", "d"}
    assert {r.path for r in changes.register(links, links.where("path = 'a'")).where("registered").collect()} == {"a", "b"}
    assert changes.deregister_queued(links, links).where("registered").count() == 0


def test_stream_admission_equals_batch(spark, tmp_path):
    from itertools import pairwise

    rows = [(str(k % 5), (k * 37) % 1000) for k in range(200)] + [(None, 5)]
    rows.sort(key=lambda x: x[1])
    parts = [rows[i : i + 70] for i in range(0, len(rows), 70)]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "link string, at long").coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    batch = {(r.key, r.at_ms) for r in admission.admit_log(spark.read.parquet(f"{tmp_path}/in/*"), "link", "at", 100).collect()}
    for k in "01234":
        times = sorted(t for key, t in batch if key == k)
        assert all(b - a > 100 for a, b in pairwise(times))
    got = set()
    stream = spark.readStream.schema("link string, at long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    admitted = admission.admit_stream(stream, "link", "at", 100)
    admission.each_batch(admitted, lambda df, n: got.update((r.key, r.at_ms) for r in df.collect()), f"{tmp_path}/cp")
    assert got == batch


def test_publish_stream_completes_late_edges(spark, tmp_path):
    from linkloom.functions.html import parse_documents

    store = GraphStore(spark, f"file://{tmp_path}/store")
    pages = spark.createDataFrame([(f"/wiki/{n}", h) for n, h in html()], "path string, html string")
    parsed = parse_documents(pages, fixture_analyzer).drop("error").withColumns({"unique_id": F.lit(0).cast("long"), "is_removed": F.lit(False)})
    for i, cut in enumerate(("path <= '/wiki/3'", "path > '/wiki/3'")):
        parsed.where(cut).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    stream = spark.readStream.schema(parsed.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    admission.publish_stream(stream, store, f"{tmp_path}/cp")
    assert len(store.versions()) == 2
    assert edges(store) == {(a, b) for a, v in GRAPH.items() for b in v[2]}


def test_shell(spark, tmp_path):
    out = io.StringIO()
    config = crawl.CrawlConfig(ttl_ms=0, factory=fixture_analyzer, clock=Clock())
    shell = cli.Shell(spark, f"file://{tmp_path}", source(spark, GRAPH), config, out)
    shell.loop(["crawler start --start-link https://en.wikipedia.org/wiki/1", "crawler wait", "wiki", "wiki 4", "wiki -p 5 7 4", "wiki -p 5", "wiki 99", "nothing", "exit", "wiki"])
    text = out.getvalue()
    assert "7 pages in" in text
    assert "4\n - 3\n - 5\n" in text
    assert "https://en.wikipedia.org/wiki/4" in text
    assert "[5 -> 4 -> 3 -> 1 -> 7]" in text and "[7 -> 6 -> 1 -> 3 -> 4]" in text
    assert "A path needs two titles" in text and "A page was not found" in text and "Unknown command" in text
    assert not shell.running
    verbs = shell.verbs
    assert verbs.find("WIKI") and verbs.has("wiki") and not verbs.has("WIKI") and verbs.names() == ["wiki", "crawler", "exit"]
    verbs.remove("Exit")
    assert verbs.find("exit") is None
    assert cli.completions(["cr"]) == ["crawler"] and cli.completions(["crawler", "sto"]) == ["stop"]


def test_change_detection(spark):
    old = spark.createDataFrame([("a", "t", "d", False, "Article"), ("b", "t", None, False, "Article")], "path string, title string, description string, is_redirect boolean, article_type string")
    new = spark.createDataFrame([("a", "t", "d", False, "Article"), ("b", "t", "x", False, "Article"), ("c", "t", "d", True, "")], old.schema)
    got = {r.path: (r.action, r.changed) for r in changes.page_changes(old, new).collect()}
    assert got == {"a": ("update", False), "b": ("update", True), "c": ("create", True)}


def test_a_crawl_broadcasts_by_rows_and_not_by_files(spark, tmp_path):
    spark.range(1_500_000).selectExpr("concat('/wiki/', lpad(string(id), 12, '0')) AS path").write.option("compression", "zstd").parquet(f"{tmp_path}/paths")

    def planned():
        joined = spark.range(10**7).selectExpr("string(id) AS path").join(spark.read.parquet(f"{tmp_path}/paths"), "path")
        return joined._jdf.queryExecution().sparkPlan().toString()

    had = spark.conf.get(crawl.FACTOR)
    assert "BroadcastHashJoin" in planned()
    with crawl.sized_rows(spark):
        assert "BroadcastHashJoin" not in planned()
    assert spark.conf.get(crawl.FACTOR) == had


def test_records_meet_a_small_frontier_without_a_shuffle_of_them(spark, tmp_path):
    from linkloom.sources.fetch import RecordedSource

    spark.range(5000).selectExpr("concat('/wiki/', id) AS path", "repeat(sha2(string(id), 512), 60) AS html", "'SUCCESS' AS status").write.parquet(f"{tmp_path}/records")
    records = spark.read.parquet(f"{tmp_path}/records")
    asked = spark.createDataFrame([("/wiki/3",), ("/wiki/x",)], "path string")
    found = RecordedSource(records)(asked)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.path, r.status, len(r.html or "")) for r in found.collect()) == [("/wiki/3", "SUCCESS", 128 * 60), ("/wiki/x", "DOES_NOT_EXIST", 0)]
