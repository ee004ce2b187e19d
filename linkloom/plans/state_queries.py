"""Queries over snapshots and the crawl log: upserts, change detection, link states, time to live, workers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import changes, graph, report
from linkloom.plans.registry import query
from linkloom.sources.tables import table
from linkloom.streaming import admission

TTL = 100_000


def _old(spark, sf_dir) -> DataFrame:
    """Stored snapshot: all orders."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")


def _new(spark, sf_dir) -> DataFrame:
    """Incoming rows: urgent orders, most with another status, and all that are in progress under keys that nothing has."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' OR o_orderpriority IN ('1-URGENT', '2-HIGH')")
    key = F.when(F.col("o_orderstatus") == "P", -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus"))
    return orders.select(key.alias("o_orderkey"), status.alias("o_orderstatus"), "o_orderpriority")


_OLD = "old AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders)"
_NEW = """new AS (SELECT CASE WHEN o_orderstatus = 'P' THEN -1 - o_orderkey ELSE o_orderkey END AS o_orderkey,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority
  FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority IN ('1-URGENT', '2-HIGH'))"""


@query("upsert_pages", f"WITH {_OLD}, {_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def upsert_pages(spark, sf_dir):
    return changes.upsert(_old(spark, sf_dir), _new(spark, sf_dir), "o_orderkey")


@query("insert_if_absent", f"WITH {_OLD}, {_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def insert_if_absent(spark, sf_dir):
    return changes.insert_if_absent(_old(spark, sf_dir), _new(spark, sf_dir), "o_orderkey")


@query("delete_links", f"WITH {_OLD}, {_NEW} SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def delete_links(spark, sf_dir):
    return changes.delete(_old(spark, sf_dir), _new(spark, sf_dir), "o_orderkey")


@query(
    "save_pages",
    f"WITH {_OLD}, {_NEW} SELECT o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, o.o_orderpriority FROM old o LEFT JOIN new n USING (o_orderkey)",
)
def save_pages(spark, sf_dir):
    return changes.save(_old(spark, sf_dir), _new(spark, sf_dir).select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("staged_lookup", f"WITH {_OLD}, {_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def staged_lookup(spark, sf_dir):
    return graph.staged_over(_new(spark, sf_dir), _old(spark, sf_dir), "o_orderkey")


@query("total_size", f"WITH {_OLD}, {_NEW} SELECT (SELECT count(*) FROM old) + (SELECT count(*) FROM new) AS n_pages")
def total_size(spark, sf_dir):
    return graph.total_size(_old(spark, sf_dir).withColumnRenamed("o_orderkey", "path"), _new(spark, sf_dir).withColumnRenamed("o_orderkey", "path"))


_JUDGED = """SELECT n.o_orderkey AS path, CASE WHEN o.o_orderkey IS NULL THEN 'create' ELSE 'update' END AS action,
  n.o_orderstatus IS DISTINCT FROM o.o_orderstatus OR n.o_orderpriority IS DISTINCT FROM o.o_orderpriority AS changed
  FROM new n LEFT JOIN old o USING (o_orderkey)"""


def _judged(spark, sf_dir) -> DataFrame:
    rename = {"o_orderkey": "path", "o_orderstatus": "title", "o_orderpriority": "description"}
    stored, incoming = (f(spark, sf_dir).withColumnsRenamed(rename) for f in (_old, _new))
    return changes.page_changes(stored, incoming, ("title", "description"))


@query("page_changes", f"WITH {_OLD}, {_NEW}, j AS ({_JUDGED}) SELECT path, changed FROM j WHERE action = 'update'")
def page_changes(spark, sf_dir):
    return _judged(spark, sf_dir).where("action = 'update'").select("path", "changed")


@query("create_or_update", f"WITH {_OLD}, {_NEW}, j AS ({_JUDGED}) SELECT action, changed, count(*) AS n FROM j GROUP BY ALL")
def create_or_update(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("action", "changed").agg(F.count("*").alias("n"))


@query(
    "retitle",
    "SELECT o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'new ' || o_orderstatus ELSE o_orderstatus END AS title FROM orders",
)
def retitle(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("title"))
    return changes.retitle(pages, pages.where("path % 3 = 0").select("path", F.concat(F.lit("new "), F.col("title")).alias("title")))


_LINKSETS = """a AS (SELECT l_orderkey AS k, list(DISTINCT CAST(l_partkey AS VARCHAR)) AS s FROM lineitem GROUP BY 1),
  b AS (SELECT l_orderkey AS k, list(DISTINCT CAST(l_partkey AS VARCHAR)) AS s FROM lineitem WHERE l_linenumber > 1 OR l_orderkey % 2 = 0 GROUP BY 1)"""


@query(
    "link_set_changes",
    f"WITH {_LINKSETS} SELECT k, len(a.s) <> coalesce(len(b.s), 0) OR len(list_filter(a.s, lambda x: NOT list_contains(coalesce(b.s, []), x))) > 0 AS changed FROM a LEFT JOIN b USING (k)",
)
def link_set_changes(spark, sf_dir):
    """All parts of an order against those that a stored version has."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").cast("string").alias("p"), "l_linenumber")
    new = lines.groupBy("k").agg(F.collect_set("p").alias("links"))
    old = lines.where("l_linenumber > 1 or k % 2 = 0").groupBy("k").agg(F.collect_set("p").alias("neighbours"))
    return new.join(old, "k", "left").select("k", changes.link_sets_differ(F.col("links"), F.col("neighbours")).alias("changed"))


def _edges(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query("clear_out_edges", "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey % 3 <> 0")
def clear_out_edges(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return changes.clear_out_edges(edges, edges.where("src % 3 = 0"))


@query(
    "relink",
    """SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey % 3 <> 0
    UNION SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey % 3 = 0""",
)
def relink(spark, sf_dir):
    fresh = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return changes.relink(_edges(spark, sf_dir), fresh, fresh)


# -- link states from the crawl log: a user is a link, an event a visit ----------

_STATE = """s AS (SELECT CAST(user_id AS VARCHAR) AS path, max(epoch_us(ts) // 1000) AS last FROM events GROUP BY 1), n AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events)"""
#: As long as a twentieth of the log.
_TTL = "(SELECT (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) // 20 FROM events)"


def _log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "event_type", "value")


def _span(spark, sf_dir) -> tuple[int, int]:
    low, high = _log(spark, sf_dir).agg(F.min("at_ms"), F.max("at_ms")).first()
    return high, (high - low) // 20


def _states(spark, sf_dir) -> DataFrame:
    seen = admission.latest_visits(_log(spark, sf_dir), "user_id", "at_ms")
    made = changes.default_links(seen.select("path")).drop("last_processed_ms")
    return made.join(seen, "path").withColumn("registered", F.col("path").cast("long") % 10 == 0)


@query("stale_links", f"WITH {_STATE} SELECT path, last AS last_processed_ms FROM s, n WHERE last < now - {_TTL}")
def stale_links(spark, sf_dir):
    now, ttl = _span(spark, sf_dir)
    return changes.stale_links(_states(spark, sf_dir), now - ttl).select("path", "last_processed_ms")


@query("should_be_crawled", f"WITH {_STATE} SELECT path, CAST(path AS BIGINT) % 10 <> 0 AND now - last > {_TTL} AS due FROM s, n")
def should_be_crawled(spark, sf_dir):
    now, ttl = _span(spark, sf_dir)
    return _states(spark, sf_dir).select("path", changes.is_due(now, ttl).alias("due"))


@query(
    "link_state_get_or_make",
    f"""WITH {_STATE}, w AS (SELECT CAST(c_custkey AS VARCHAR) AS path FROM customer)
    SELECT path, sha256(path) AS link_id, s.path IS NOT NULL AND CAST(path AS BIGINT) % 10 = 0 AS registered, coalesce(last, -1) AS last_processed_ms FROM w LEFT JOIN s USING (path)""",
)
def link_state_get_or_make(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"))
    return changes.get_or_make_links(_states(spark, sf_dir), wanted).select("path", "link_id", "registered", "last_processed_ms")


@query(
    "mark_processed",
    f"WITH {_STATE} SELECT path, CAST(path AS BIGINT) % 2 = 0 AS processed, CAST(path AS BIGINT) % 10 = 0 AND CAST(path AS BIGINT) % 2 <> 0 AS registered, "
    "CAST(path AS BIGINT) % 4 = 0 AS page_found, CASE WHEN CAST(path AS BIGINT) % 2 = 0 THEN 5 ELSE last END AS last_processed_ms FROM s",
)
def mark_processed(spark, sf_dir):
    links = _states(spark, sf_dir)
    visited = links.where("cast(path as bigint) % 2 = 0").select("path", (F.col("path").cast("long") % 4 == 0).alias("page_found"))
    return changes.mark_processed(links, visited, 5).select("path", "processed", "registered", "page_found", "last_processed_ms")


@query("fetch_routing", "SELECT event_type, CASE event_type WHEN 'click' THEN 'parse' WHEN 'view' THEN 'unlink' ELSE 'stash' END AS route, count(*) AS n FROM events GROUP BY ALL")
def fetch_routing(spark, sf_dir):
    status = F.when(F.col("event_type") == "click", "SUCCESS").when(F.col("event_type") == "view", "DOES_NOT_EXIST").otherwise("CONNECTION_ERROR")
    routed = changes.fetch_routes(_log(spark, sf_dir).withColumn("status", status))
    return routed.groupBy("event_type", "route").agg(F.count("*").alias("n"))


@query(
    "recrawl_admission",
    f"""WITH RECURSIVE v AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS t FROM events WHERE user_id IS NOT NULL), a AS (
      SELECT user_id, min(t) AS t FROM v GROUP BY user_id
      UNION ALL SELECT user_id, t FROM (SELECT v.user_id, min(v.t) AS t FROM a JOIN v ON v.user_id = a.user_id AND v.t - a.t > {_TTL} GROUP BY v.user_id, a.t))
    SELECT CAST(user_id AS VARCHAR) AS key, t AS at_ms FROM a""",
)
def recrawl_admission(spark, sf_dir):
    _, ttl = _span(spark, sf_dir)
    return admission.admit_log(_log(spark, sf_dir), "user_id", "at_ms", ttl)


@query("worker_totals", "SELECT user_id, event_type, count(*) AS items, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def worker_totals(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return report.worker_totals(log, "user_id", "event_type", "cents")


@query(
    "worker_report",
    """SELECT worker, items, total, round(total / items, 6) AS mean FROM (
      SELECT CASE WHEN grouping(user_id) = 1 THEN 'Total' ELSE CAST(user_id AS VARCHAR) END AS worker, count(*) AS items,
             CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ROLLUP (user_id))""",
)
def worker_report(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return report.worker_report(log, "user_id", "cents").withColumn("mean", F.round("mean", 6))
