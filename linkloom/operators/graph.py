"""Pages, links and edges: lookups, edge resolution, neighbours, counts.

``pages`` has at least ``path``; ``raw_links`` is (src_path, dst_path); ``edges`` is
(src, dst). Joins are plain equi-joins on the path: adaptive execution broadcasts
a side that turns out small and splits skewed keys, at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.scratch import written


def explode_links(parsed: DataFrame) -> DataFrame:
    """(src_path, dst_path) from rows with an array of links."""
    return parsed.select(F.col("path").alias("src_path"), F.explode("links").alias("dst_path"))


def resolved_edges(raw_links: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct edges whose target is a known page; self-loops count, as a page's own links wait for it too."""
    known = pages.select(F.col("path").alias("dst_path")).distinct()
    return raw_links.join(known, "dst_path").select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")).distinct()


def dangling_links(raw_links: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct links whose target is not known."""
    known = pages.select(F.col("path").alias("dst_path"))
    return raw_links.join(known, "dst_path", "left_anti").select("src_path", "dst_path").distinct()


def pending_sources(dangling: DataFrame) -> DataFrame:
    """For each unknown target, the pages that wait for it."""
    return dangling.groupBy("dst_path").agg(F.array_sort(F.collect_set("src_path")).alias("sources"))


def complete_edges(dangling: DataFrame, new_pages: DataFrame) -> DataFrame:
    """Edges that waiting links gain when their target arrives."""
    return resolved_edges(dangling, new_pages)


def pages_in(pages: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """The pages whose key is in a list of keys."""
    return pages.join(keys.select(key).distinct(), key, "left_semi").select(*pages.columns)


def page_by_title(pages: DataFrame, title: str) -> DataFrame:
    return pages.where(F.col("title") == title)


def page_by_id(pages: DataFrame, unique_id: int) -> DataFrame:
    return pages.where(F.col("unique_id") == unique_id)


def page_by_path(pages: DataFrame, path: str) -> DataFrame:
    return pages.where(F.col("path") == path)


def last_by_title(pages: DataFrame, order: str = "unique_id") -> DataFrame:
    """One page per title, the last written; an aggregate of a struct, so there is no sort."""
    names = pages.columns
    row = F.max_by(F.struct(*names), F.struct(order, "path")).alias("row")
    return pages.groupBy("title").agg(row).select(*[F.col(f"row.{n}").alias(n) for n in names])


def staged_over(staged: DataFrame, stored: DataFrame, key: str = "path") -> DataFrame:
    """What is staged, and what is stored under other keys."""
    return staged.unionByName(stored.join(staged.select(key), key, "left_anti").select(*staged.columns))


def neighbours(edges: DataFrame, pages: DataFrame, path: str) -> DataFrame:
    """The pages that one page links to."""
    out = edges.where(F.col("src") == path).select(F.col("dst").alias("path")).distinct()
    return pages_in(pages, out)


def neighbour_sets(edges: DataFrame) -> DataFrame:
    """(src, neighbours): distinct sorted targets of each source."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def union_neighbours(stored: DataFrame, cached: DataFrame) -> DataFrame:
    """Edges that either side knows."""
    return stored.unionByName(cached).distinct()


def resolve_titles(pages: DataFrame, arguments: DataFrame) -> DataFrame:
    """(position, title, path) for a list of titles; nothing at all if one of them is unknown.

    ``arguments`` has position and title. Of several pages with a title the last
    written counts. Only pages with an asked title are grouped.
    """
    asked = pages_in(pages, arguments, "title")
    wanted = arguments.join(last_by_title(asked).select("title", "path"), "title", "left")
    # one row over the answer, not over the pages
    whole = wanted.agg(F.count(F.when(F.col("path").isNull(), 1)).alias("misses")).where("misses = 0")
    return wanted.crossJoin(F.broadcast(whole)).select("position", "title", "path")


#: Members of a group that travel as one row, and parts that the groups of one element are dealt to.
PACKED, SALTS = 256, 8


def sharing(left: DataFrame, right: DataFrame, items: str) -> DataFrame:
    """Each row of ``left`` with each of ``right`` whose sets ``items`` have an element in common, once; the columns of both but ``items``.

    Rows meet at each element that they share and are taken at the least of them, so
    nothing is to be freed of repeats afterwards and the pairs are not shuffled. What
    holds a frequent element is dealt to ``SALTS`` parts on the left, and told to each
    of them on the right.
    """
    n = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.withColumnRenamed(items, "__a").withColumn("__salt", F.pmod(F.xxhash64(*[c for c in left.columns if c != items]), F.lit(SALTS)).cast("int"))
    b = right.withColumnRenamed(items, "__b").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    a = a.withColumn("__item", F.explode("__a")).repartition(n, "__item", "__salt")
    b = b.withColumn("__item", F.explode("__b")).repartition(n, "__item", "__salt")
    met = a.join(b, ["__item", "__salt"]).where(F.array_min(F.array_intersect("__a", "__b")) == F.col("__item"))
    return met.drop("__item", "__salt", "__a", "__b")


def _packed(rows: DataFrame, key: str, items: str, name: str) -> DataFrame:
    """(items, name): keys of equal sets, about ``PACKED`` to a row."""
    sizes = rows.groupBy(items).agg(F.count("*").alias("__n"))
    part = F.pmod(F.xxhash64(key), F.ceil(F.col("__n") / PACKED))
    return rows.join(sizes, items).groupBy(items, part.alias("__part")).agg(F.collect_list(F.struct(key)).alias(name)).drop("__part")


def sharing_pairs(left: DataFrame, right: DataFrame, key: str, items: str) -> DataFrame:
    """(src, dst): keys of left and right rows whose sets have an element in common. Keys are distinct on each side."""
    met = sharing(_packed(left, key, items, "__srcs"), _packed(right, key, items, "__dsts"), items)
    met = met.select(F.explode("__srcs").alias("__src"), "__dsts").select("__src", F.explode("__dsts").alias("__dst"))
    return met.select(F.col(f"__src.{key}").alias("src"), F.col(f"__dst.{key}").alias("dst"))


def with_ids(pages: DataFrame, start: int = 0, ranges: int | None = None) -> DataFrame:
    """Dense ids from ``start`` in order of path, without gathering all rows.

    Rows are written once with the number of their range; counts and ranks come from
    what was written, so both see the same ranges: at most ``ranges`` of them, by default
    as many as a shuffle has partitions.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = n if ranges is None else min(n, ranges)
    ranged = pages.drop("unique_id").repartitionByRange(n, "path").withColumn("__part", F.spark_partition_id())
    dealt = written(ranged, "ranges")
    sizes = dealt.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__part").orderBy("path")
    numbered = dealt.withColumn("__nth", F.row_number().over(own)).join(F.broadcast(offsets), "__part")
    return numbered.withColumn("unique_id", F.col("__before") + F.col("__nth") - 1 + F.lit(start)).drop("__part", "__nth", "__before")


def count_pages(pages: DataFrame) -> DataFrame:
    """All pages, and distinct titles, which is what a title index would count."""
    return pages.agg(F.count("*").alias("n_pages"), F.count_distinct("title").alias("n_titles"))


def total_size(stored: DataFrame, staged: DataFrame) -> DataFrame:
    return stored.select("path").unionByName(staged.select("path")).agg(F.count("*").alias("n_pages"))
