"""Queries through the store, its services, streams and the command line."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom import cli
from linkloom.functions.html import fixture_analyzer
from linkloom.operators import crawl
from linkloom.operators.services import Links, Pages
from linkloom.operators.store import Delta, GraphStore
from linkloom.plans.graph_queries import _EDGES, part_edges
from linkloom.plans.parse_queries import NATIONS, fixture_folder
from linkloom.plans.registry import query
from linkloom.plans.state_queries import _TTL, _log, _span
from linkloom.scratch import new_path, written
from linkloom.sources import fetch
from linkloom.sources.tables import table
from linkloom.streaming import admission


def _store(spark, name: str, **shape) -> GraphStore:
    return GraphStore(spark, new_path(spark, name), parts=3, **shape)


def _pages(orders: DataFrame, title, start: int = 0) -> DataFrame:
    """Orders as pages."""
    return orders.select(
        F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") + start).alias("unique_id"), title.alias("title"), F.col("o_orderpriority").alias("description"),
        F.lit(False).alias("is_redirect"), F.lit("Article").alias("article_type"), F.lit(False).alias("is_removed"), F.create_map(F.lit("en"), F.col("o_orderkey").cast("string")).alias("locales"),
    )


def _page_store(spark, sf_dir, **shape) -> GraphStore:
    """All orders as pages, then a delta per priority that renames its orders; the store merges some of them."""
    store, orders = _store(spark, "pages", **shape), table(spark, sf_dir, "orders")
    store.commit(pages=_pages(orders, F.col("o_orderstatus")))
    for k, priority in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "1-URGENT")):
        store.commit(pages=_pages(orders.where(F.col("o_orderpriority") == priority), F.concat(F.lit(f"v{k} "), "o_orderstatus")))
    return store


_STORED = """p AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS unique_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'v3 ' WHEN '2-HIGH' THEN 'v1 ' WHEN '3-MEDIUM' THEN 'v2 ' ELSE '' END || o_orderstatus AS title,
  o_orderpriority AS description FROM orders)"""


@query("store_pages", f"WITH {_STORED} SELECT path, unique_id, title, description FROM p")
def store_pages(spark, sf_dir):
    """A table of a base and deltas, merged where it is read."""
    return Pages(_page_store(spark, sf_dir)).all().select("path", "unique_id", "title", "description")


@query("store_lookups", f"WITH {_STORED} SELECT 'path' AS asked, path, title FROM p WHERE path = '7' UNION ALL SELECT 'id', path, title FROM p WHERE unique_id = 11 UNION ALL SELECT 'title', path, title FROM p WHERE title = 'v1 P'")
def store_lookups(spark, sf_dir):
    pages = Pages(_page_store(spark, sf_dir))
    found = [("path", pages.by_path("7")), ("id", pages.by_id(11)), ("title", pages.by_title("v1 P"))]
    out = None
    for asked, rows in found:
        part = rows.select(F.lit(asked).alias("asked"), "path", "title")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "store_bucket_lookups",
    f"""WITH {_STORED}, l AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS path FROM lineitem WHERE l_returnflag = 'R')
    SELECT 'listed' AS asked, path, title FROM p WHERE unique_id IN (SELECT min(o_orderkey) FROM orders GROUP BY o_orderpriority)
    UNION ALL SELECT 'joined', path, title FROM p JOIN l USING (path)""",
)
def store_bucket_lookups(spark, sf_dir):
    """Of a store of 64 buckets: a few pages by a list of paths, which opens their buckets, and many by a table of paths, which shuffles the paths alone."""
    store, orders = _page_store(spark, sf_dir, buckets=64), table(spark, sf_dir, "orders")
    first = orders.groupBy("o_orderpriority").agg(F.min("o_orderkey").cast("string").alias("path")).select("path")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("path")).distinct()
    listed = store.lookup("pages", store.few(first)).select(F.lit("listed").alias("asked"), "path", "title")
    return listed.unionByName(store.lookup("pages", returned).select(F.lit("joined").alias("asked"), "path", "title"))


@query("title_index", f"WITH {_STORED} SELECT title, path FROM p")
def title_index(spark, sf_dir):
    """Which paths have a title, after pages were renamed by four commits: old titles are gone."""
    return _page_store(spark, sf_dir).read("titles").select("title", "path")


@query(
    "titles_resolved",
    f"""WITH {_STORED}, last AS (SELECT title, arg_max(path, unique_id) AS path FROM p GROUP BY title),
    asked AS (SELECT CAST(row_number() OVER (ORDER BY t) AS BIGINT) AS position, t AS title FROM (SELECT DISTINCT o_orderstatus AS t FROM orders UNION SELECT DISTINCT 'v1 ' || o_orderstatus FROM orders))
    SELECT position, title, path FROM asked JOIN last USING (title)""",
)
def titles_resolved(spark, sf_dir):
    """Titles of both generations by the index; the last page of each counts."""
    states = table(spark, sf_dir, "orders").select("o_orderstatus").distinct()
    asked = states.select(F.col("o_orderstatus").alias("title")).unionByName(states.select(F.concat(F.lit("v1 "), "o_orderstatus").alias("title")))
    asked = asked.withColumn("position", F.row_number().over(Window.orderBy("title")).cast("long"))  # a handful of states
    return Pages(_page_store(spark, sf_dir)).by_titles(asked)


#: Parts have pages from the first commit on (size up to 25), from the second (up to 40), or never.
_WAITING = f"""WITH {_EDGES}, r AS (SELECT src, dst FROM e JOIN part s ON s.p_partkey = src JOIN part d ON d.p_partkey = dst
    WHERE s.p_size <= 40 AND NOT (s.p_size <= 10 AND d.p_brand = 'Brand#11'))
  SELECT CAST(dst AS VARCHAR) AS dst, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(src AS VARCHAR), ',' ORDER BY CAST(src AS VARCHAR)) AS sources
  FROM r JOIN part d ON d.p_partkey = dst WHERE d.p_size > 40 GROUP BY dst"""


def _edited_store(spark, sf_dir) -> GraphStore:
    """Pages and their links in two commits; then small parts lose their links to one brand."""
    store, part = _store(spark, "waiting"), table(spark, sf_dir, "part").withColumnsRenamed({"p_partkey": "o_orderkey", "p_type": "o_orderpriority"})
    sizes = part.select(F.col("o_orderkey").alias("src"), F.col("p_size").alias("size"))
    edges = written(part_edges(spark, sf_dir).join(sizes, "src"), "edges")
    links = edges.select("size", F.col("src").cast("string").alias("src_path"), F.col("dst").cast("string").alias("dst_path"))
    for low, high in ((0, 25), (25, 40)):
        now = F.col("p_size").between(low + 1, high)
        store.commit(pages=_pages(part.where(now), F.col("p_name")), raw_links=Delta(links.where(F.col("size").between(low + 1, high)).drop("size"), adds=True))
    brand = part.where("p_brand = 'Brand#11'").select(F.col("o_orderkey").cast("string").alias("dst_path"))
    small = links.where("size <= 10").drop("size")
    store.commit(raw_links=Delta(small.join(brand, "dst_path", "left_anti").select("src_path", "dst_path"), small.select("src_path")))
    return store


@query("waiting_links", _WAITING)
def waiting_links(spark, sf_dir):
    """The index of waiting links after pages came and links were taken back: what is left waits for pages that never came."""
    waiting = Pages(_edited_store(spark, sf_dir)).pending()
    return waiting.select(F.col("dst_path").alias("dst"), F.size("sources").cast("long").alias("n"), F.array_join("sources", ",").alias("sources"))


@query(
    "store_bare_and_saved",
    f"""WITH {_STORED}, m AS (SELECT CAST(max(o_orderkey) AS BIGINT) AS top FROM orders)
    SELECT path, CASE WHEN description = '5-LOW' THEN 'saved' ELSE title END AS title FROM p
    UNION ALL SELECT CAST(c_custkey + top + 1 AS VARCHAR), 'bare' FROM customer, m""",
)
def store_bare_and_saved(spark, sf_dir):
    """Bare pages for customers (those of paths that have a page are left out); then a column of some pages is saved, and nothing added by it."""
    store = _page_store(spark, sf_dir)
    pages, orders = Pages(store), table(spark, sf_dir, "orders")
    top = pages.next_id()
    bare = table(spark, sf_dir, "customer").select((F.col("c_custkey") + top).alias("o_orderkey"), F.lit("").alias("o_orderpriority"))
    pages.create_bare(_pages(bare, F.lit("bare")).unionByName(_pages(orders, F.lit("never"))))
    low = orders.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").cast("string").alias("path"), F.lit("saved").alias("title"))
    pages.save(low.unionByName(spark.createDataFrame([("nowhere", "saved")], "path string, title string")))
    return pages.all().select("path", "title")


@query("store_counts", "SELECT count(*) AS pages, CAST(max(o_orderkey) + 1 AS BIGINT) AS next_id FROM orders")
def store_counts(spark, sf_dir):
    pages = Pages(_page_store(spark, sf_dir))
    return spark.createDataFrame([(pages.count(), pages.next_id())], "pages long, next_id long")


@query(
    "store_neighbours",
    f"""WITH {_EDGES} SELECT 'out' AS side, dst AS v FROM e WHERE src = 3 UNION ALL SELECT 'in', src FROM e WHERE dst = 3
    UNION ALL SELECT 'cleared', dst FROM e WHERE src = 5""",
)
def store_neighbours(spark, sf_dir):
    """Neighbours, the pages that state a link to a path, and what is left of out-edges of which one page's were cleared."""
    store = _store(spark, "edges")
    edges = part_edges(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    part = table(spark, sf_dir, "part").withColumnsRenamed({"p_partkey": "o_orderkey", "p_type": "o_orderpriority"})
    store.commit(pages=_pages(part, F.col("p_name")), edges=Delta(edges, adds=True), raw_links=Delta(edges.toDF("src_path", "dst_path"), adds=True))
    pages = Pages(store)
    near = written(pages.neighbours("3").select(F.lit("out").alias("side"), "path").unionByName(pages.stating("3").select(F.lit("in").alias("side"), "path")), "near")
    pages.clear_out_edges(spark.createDataFrame([("3",)], "path string"))
    left = pages.neighbours("3").unionByName(pages.neighbours("5")).select(F.lit("cleared").alias("side"), "path")
    return near.unionByName(left).select("side", F.col("path").cast("long").alias("v"))


def _link_store(spark, sf_dir) -> Links:
    """A link per user of the log, created, then updated with its last visit, some deleted."""
    _, ttl = _span(spark, sf_dir)
    links = Links(_store(spark, "links"), ttl)
    last = written(admission.latest_visits(_log(spark, sf_dir).where("user_id is not null"), "user_id", "at_ms"), "last")
    links.create(last)
    links.create(last)  # a second time makes nothing
    states = links.all().drop("last_processed_ms").join(last, "path")
    links.update(states.withColumn("processed", F.lit(True)))
    links.delete(last.where("path like '%3'"))
    return links


_LINKS = "s AS (SELECT CAST(user_id AS VARCHAR) AS path, max(epoch_us(ts) // 1000) AS last FROM events WHERE user_id IS NOT NULL GROUP BY 1), k AS (SELECT * FROM s WHERE path NOT LIKE '%3')"


@query("links_all", f"WITH {_LINKS} SELECT path, sha256(path) AS link_id, true AS processed, false AS registered, last AS last_processed_ms FROM k")
def links_all(spark, sf_dir):
    return _link_store(spark, sf_dir).all().select("path", "link_id", "processed", "registered", "last_processed_ms")


@query("link_by_path", f"WITH {_LINKS} SELECT path, last AS last_processed_ms FROM k WHERE path = (SELECT min(path) FROM k)")
def link_by_path(spark, sf_dir):
    links = _link_store(spark, sf_dir)
    return links.by_path(links.all().agg(F.min("path")).first()[0]).select("path", "last_processed_ms")


@query("links_before", f"WITH {_LINKS} SELECT path FROM k WHERE last < (SELECT max(last) FROM k) - {_TTL}")
def links_before(spark, sf_dir):
    links = _link_store(spark, sf_dir)
    return links.before(links.all().agg(F.max("last_processed_ms")).first()[0] - links.ttl_ms).select("path")


@query("links_due", f"WITH {_LINKS}, n AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events) SELECT s.path, k.path IS NULL OR now - s.last > {_TTL} AS due FROM s LEFT JOIN k USING (path), n")
def links_due(spark, sf_dir):
    """Links without a state may be visited."""
    links, (now, _) = _link_store(spark, sf_dir), _span(spark, sf_dir)
    users = _log(spark, sf_dir).where("user_id is not null").select(F.col("user_id").cast("string").alias("path")).distinct()
    return links.due(users, now)


@query("links_count", f"WITH {_LINKS} SELECT count(*) AS n FROM k")
def links_count(spark, sf_dir):
    return spark.createDataFrame([(_link_store(spark, sf_dir).count(),)], "n long")


@query("url_upsert", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN lang = 'en' THEN 'en:second' ELSE lang || ':first' END AS locales FROM documents WHERE lang IS NOT NULL")
def url_upsert(spark, sf_dir):
    """The last map of a link is its map."""
    links, docs = Links(_store(spark, "urls")), table(spark, sf_dir, "documents").where("lang is not null")
    for word, rows in (("first", docs), ("second", docs.where("lang = 'en'"))):
        links.put_urls(rows.select(F.col("doc_id").cast("string").alias("path"), F.create_map("lang", F.lit(word)).alias("locales")))
    return links.urls().select("path", F.concat(F.map_keys("locales")[0], F.lit(":"), F.map_values("locales")[0]).alias("locales"))


@query("staging_published", f"WITH {_STORED} SELECT path, CASE WHEN description = '1-URGENT' THEN 'staged' ELSE title END AS title, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS seen FROM p")
def staging_published(spark, sf_dir):
    """Staged pages are drained into the store; the action sees them before."""
    store, seen = _page_store(spark, sf_dir), []
    staged = _pages(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), F.lit("staged"))
    store.publish({"pages": staged}, lambda tables: seen.append(tables["pages"].count()))
    return store.read("pages").select("path", "title", F.lit(seen[0]).cast("long").alias("seen"))


# -- streams ------------------------------------------------------------------


def _stream(spark, sf_dir: str, name: str) -> DataFrame:
    kind = table(spark, sf_dir, name).schema
    return spark.readStream.schema(kind).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query(
    "stream_admission",
    f"""WITH RECURSIVE v AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS t FROM events WHERE user_id IS NOT NULL), a AS (
      SELECT user_id, min(t) AS t FROM v GROUP BY user_id
      UNION ALL SELECT user_id, t FROM (SELECT v.user_id, min(v.t) AS t FROM a JOIN v ON v.user_id = a.user_id AND v.t - a.t > {_TTL} GROUP BY v.user_id, a.t))
    SELECT CAST(user_id AS VARCHAR) AS key, t AS at_ms FROM a""",
)
def stream_admission(spark, sf_dir):
    """The log as a stream, with the last admission of each link as keyed state."""
    _, ttl = _span(spark, sf_dir)
    events = _stream(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    out = new_path(spark, "admitted")
    admitted = admission.admit_stream(events, "user_id", "at_ms", ttl)
    admission.each_batch(admitted, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), new_path(spark, "checkpoint"))
    return spark.read.schema("key string, at_ms long").parquet(out).select("key", "at_ms")


@query("stream_publish", f"WITH {_EDGES} SELECT src, dst FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst")
def stream_publish(spark, sf_dir):
    """Parts with an even key are in the store before; the others arrive by stream and complete the edges that wait for them."""
    edges = part_edges(spark, sf_dir).groupBy("src").agg(F.collect_set(F.col("dst").cast("string")).alias("links"))
    edges = written(edges, "links")

    def staged(rows: DataFrame) -> DataFrame:
        named = rows.withColumnsRenamed({"p_partkey": "o_orderkey", "p_type": "o_orderpriority"})
        own = edges.select(F.col("src").cast("string").alias("path"), "links")
        pages = _pages(named, F.col("p_name")).join(own, "path", "left")
        return pages.withColumn("links", F.coalesce("links", F.array().cast("array<string>")))

    store = _store(spark, "stream")
    admission.publish_batch(staged(table(spark, sf_dir, "part").where("p_partkey % 2 = 0")), store)
    admission.publish_stream(staged(_stream(spark, sf_dir, "part").where("p_partkey % 2 = 1")), store, new_path(spark, "checkpoint"))
    return store.read("edges").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


# -- command line -------------------------------------------------------------

_said: dict[tuple, list[tuple[str, str]]] = {}


def _session(spark, sf_dir: str) -> list[tuple[str, str]]:
    """(command, line) of a shell that crawls the nations' files and answers; once in a session."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _said:
        end = table(spark, sf_dir, "nation").where("n_regionkey <> 0").agg(F.min_by(F.translate("n_name", "_", " "), "n_nationkey")).first()[0]
        first = table(spark, sf_dir, "region").where("r_regionkey = 0").first()["r_name"]
        config = crawl.CrawlConfig(factory=fixture_analyzer)
        shell = cli.Shell(spark, new_path(spark, "shell"), fetch.FileSource(fixture_folder(spark, sf_dir)), config, io.StringIO())
        said = []
        commands = {
            "start": "crawler start --start-link https://en.wikipedia.org/wiki/r0", "wait": "CRAWLER wait", "list": "wiki", "card": f"wiki '{first}' '{end}'", "path": f"wiki -p '{first}' '{end}' '{first}'",
            "one": f"wiki -p '{first}'", "unknown title": "wiki nowhere", "unknown verb": "nothing", "exit": "exit", "after": "wiki",
        }
        for command, line in commands.items():
            shell.out.seek(0)
            shell.out.truncate()
            if shell.running:
                shell.loop([line])
            said += [(command, x) for x in shell.out.getvalue().splitlines()]
        _said[name] = said
    return _said[name]


def _lines(spark, sf_dir, *commands: str) -> DataFrame:
    rows = [(c, n, line) for c in commands for n, line in enumerate(x for k, x in _session(spark, sf_dir) if k == c)]
    return spark.createDataFrame(rows, "command string, n long, line string")


_TITLED = "g AS (SELECT l.src, f.title FROM l JOIN f ON f.name = dst)"


@query(
    "shell_listing",
    f"""WITH {NATIONS}, {_TITLED}, x AS (SELECT name, 0 AS part, title AS line FROM f UNION ALL SELECT src, 1, ' - ' || title FROM g)
    SELECT 'list' AS command, CAST(row_number() OVER (ORDER BY name, part, line) - 1 AS BIGINT) AS n, line FROM x""",
)
def shell_listing(spark, sf_dir):
    """``wiki`` after a crawl of files: every page, and below it its neighbours."""
    return _lines(spark, sf_dir, "list")


@query(
    "shell_cards",
    f"""WITH {NATIONS}, {_TITLED}, asked AS (SELECT 0 AS nth, 'r0' AS name UNION ALL SELECT 1, 'n' || min(n_nationkey) FROM nation WHERE n_regionkey <> 0),
    c AS (SELECT nth, f.* FROM asked JOIN f USING (name)),
    x AS (SELECT nth, 0 AS part, title AS line FROM c UNION ALL SELECT nth, 1, 'https://en.wikipedia.org/wiki/' || name FROM c UNION ALL SELECT nth, 2, '' FROM c UNION ALL SELECT nth, 3, description FROM c
      UNION ALL SELECT nth, 4, '' FROM c UNION ALL SELECT nth, 6, ' - ' || g.title FROM c JOIN g ON g.src = c.name)
    SELECT 'card' AS command, CAST(row_number() OVER (ORDER BY nth, part, line) - 1 AS BIGINT) AS n, line FROM x""",
)
def shell_cards(spark, sf_dir):
    """``wiki A B``: a card for each; ids follow from the crawl and are left out here."""
    lines = [line for command, line in _session(spark, sf_dir) if command == "card" and not line.isdigit()]
    return spark.createDataFrame([("card", n, line) for n, line in enumerate(lines)], "command string, n long, line string")


@query(
    "shell_paths",
    """WITH r AS (SELECT r_name AS a FROM region WHERE r_regionkey = 0), z AS (SELECT replace(n_name, '_', ' ') AS b, n_regionkey FROM nation WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey <> 0)),
    m AS (SELECT a, r_name AS via, b FROM r, z JOIN region ON r_regionkey = n_regionkey)
    SELECT 'path' AS command, CAST(0 AS BIGINT) AS n, '[' || a || ' -> ' || via || ' -> ' || b || ']' AS line FROM m
    UNION ALL SELECT 'path', 1, '[' || b || ' -> ' || via || ' -> ' || a || ']' FROM m""",
)
def shell_paths(spark, sf_dir):
    """``wiki -p A B A``: titles along the shortest paths of both legs."""
    return _lines(spark, sf_dir, "path")


@query(
    "shell_messages",
    """SELECT 'start' AS command, CAST(0 AS BIGINT) AS n, 'Crawl from https://en.wikipedia.org/wiki/r0' AS line
    UNION ALL SELECT 'wait', 0, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) || ' pages in 3 generations, 0 gone, 0 to try again (drained)'
    UNION ALL SELECT 'one', 0, 'A path needs two titles at least' UNION ALL SELECT 'unknown title', 0, 'A page was not found' UNION ALL SELECT 'unknown verb', 0, 'Unknown command nothing'""",
)
def shell_messages(spark, sf_dir):
    """What the other commands say; after ``exit`` nothing is answered."""
    return _lines(spark, sf_dir, "start", "wait", "one", "unknown title", "unknown verb", "exit", "after")


@query(
    "completions",
    """SELECT r_regionkey AS k, w AS words, a AS answer FROM region JOIN (VALUES (0, 'cr', 'crawler'), (1, 'crawler sto', 'stop'), (2, 'wiki -', '-p,--path'), (3, 'WIKI --p', '--path'), (4, 'x', '')) t(k, w, a) ON k = r_regionkey""",
)
def completions(spark, sf_dir):
    """A command, or an option of one, by its beginning."""
    words = ["cr", "crawler sto", "wiki -", "WIKI --p", "x"]
    rows = spark.createDataFrame([(k, w, ",".join(cli.completions(w.split()))) for k, w in enumerate(words)], "k long, words string, answer string")
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k")).join(rows, "k")


@query("verb_lookup", "SELECT * FROM (VALUES ('WIKI', true, false), ('wiki', true, true), ('Exit', true, false), ('gone', false, false)) t(name, found, exact)")
def verb_lookup(spark, sf_dir):
    """Found in any case, known by the exact name; what was removed is not there."""
    verbs = cli.Verbs()
    for name in ("wiki", "exit", "gone"):
        verbs.register(name, print)
    verbs.remove("GONE")
    return spark.createDataFrame([(n, verbs.find(n) is not None, verbs.has(n)) for n in ("WIKI", "wiki", "Exit", "gone")], "name string, found boolean, exact boolean")
