"""Listings and worker reports as tables of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.scratch import written

ARROW = " -> "


def adjacency_listing(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, title, listing): each page's title, then a line for each neighbour's title, sorted."""
    names = pages.select(F.col("path").alias("dst"), F.col("title").alias("name"))
    out = edges.join(names, "dst").groupBy("src").agg(F.array_sort(F.collect_list("name")).alias("names"))
    joined = pages.join(out.withColumnRenamed("src", "path"), "path", "left")
    lines = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.concat(F.lit("\n - "), n))
    return joined.select("path", "title", F.concat(F.col("title"), F.array_join(lines, "")).alias("listing"))


def lines_of(near: DataFrame, group: str) -> DataFrame:
    """(group, lines) from (group, name, n): a line for each of the ``n`` times that a name stands for, sorted by name, as one text."""
    names = near.where("name is not null").groupBy(group).agg(F.array_sort(F.collect_list(F.struct("name", F.col("n").cast("int").alias("n")))).alias("names"))
    lines = F.transform("names", lambda x: F.repeat(F.concat(F.lit("\n - "), x["name"]), x["n"]))
    return names.select(group, F.array_join(lines, "").alias("lines"))


def shared_listing(pages: DataFrame, lines: DataFrame, group: str) -> DataFrame:
    """``adjacency_listing`` where pages of a group have the same neighbours, whose lines are made once (``lines_of``)."""
    joined = pages.join(lines, group, "left")
    return joined.select("path", "title", F.concat(F.col("title"), F.coalesce("lines", F.lit(""))).alias("listing"))


def _card(url: Column) -> Column:
    flags = F.concat(F.when(F.col("is_removed"), "DELETED ").otherwise(""), F.when(F.col("is_redirect"), "REDIRECT").otherwise(""))
    return F.concat_ws("\n", "title", url, F.trim(flags), "description", "article_type", F.col("unique_id").cast("string"))


def page_card(pages: DataFrame, edges: DataFrame, url: Column) -> DataFrame:
    """(path, card): title, URL, flags, description, type and id, a line each, then a line for each neighbour's title, sorted."""
    names = pages.select(F.col("path").alias("dst"), F.col("title").alias("name"))
    near = edges.select("src", "dst").distinct().join(names, "dst").groupBy("src").agg(F.array_sort(F.collect_list("name")).alias("names"))
    joined = pages.join(near.withColumnRenamed("src", "path"), "path", "left")
    listed = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.concat(F.lit("\n - "), n))
    return joined.select("path", F.concat(_card(url), F.array_join(listed, "")).alias("card"))


def shared_card(pages: DataFrame, lines: DataFrame, group: str, url: Column) -> DataFrame:
    """``page_card`` where pages of a group have the same neighbours, whose lines are made once (``lines_of``)."""
    return pages.join(lines, group, "left").select("path", F.concat(_card(url), F.coalesce("lines", F.lit(""))).alias("card"))


def path_text(path: Column) -> Column:
    """``[A -> B -> C]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(path, lambda v: v.cast("string")), ARROW), F.lit("]"))


def titled_paths(paths: DataFrame, pages: DataFrame) -> DataFrame:
    """The rows of ``paths`` with titles in place of keys; a vertex without a page keeps its key.

    Only vertices on paths meet the pages; paths are numbered by their own text.
    """
    names = [c for c in paths.columns if c != "path"]
    keyed = paths.withColumn("__key", F.struct(*names, "path"))
    steps = keyed.select("__key", F.posexplode("path").alias("at", "v"))
    titles = pages.select(F.col("path").alias("v"), "title").join(steps.select("v").distinct(), "v", "left_semi")
    named = steps.join(titles, "v", "left").select("__key", "at", F.coalesce("title", F.col("v").cast("string")).alias("title"))
    shown = named.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("at", "title"))).alias("steps"))
    return shown.select(*[F.col(f"__key.{n}").alias(n) for n in names], F.col("steps.title").alias("path"))


def path_report(paths: DataFrame, start: str, end: str) -> DataFrame:
    """One line per path; one that says so where there is none."""
    lines = written(paths.select(path_text(F.col("path")).alias("line")), "lines")
    if lines.isEmpty():
        return paths.sparkSession.createDataFrame([(f"No path exists between {start} and {end}",)], "line string")
    return lines


def worker_totals(log: DataFrame, worker: str, kind: str, value: str) -> DataFrame:
    """Items and total time of each worker and kind of work."""
    return log.groupBy(worker, kind).agg(F.count("*").alias("items"), F.sum(value).alias("total"))


def time_report(log: DataFrame, worker: str, times: list[str], **counted: Column) -> DataFrame:
    """A row per worker, and one named Total: rows for which each condition holds, and total and mean of each time."""
    counts = [F.count(F.when(c, 1)).alias(n) for n, c in counted.items()]
    sums = [f(t).alias(n) for t in times for f, n in ((F.sum, t), (F.avg, f"mean_{t}"))]
    rolled = log.rollup(worker).agg(F.grouping(worker).alias("__all"), *counts, *sums)
    name = F.when(F.col("__all") == 1, "Total").otherwise(F.col(worker).cast("string"))
    # without rows there is nothing to be total of
    return rolled.select(name.alias("worker"), *counted, *[n for t in times for n in (t, f"mean_{t}")]).where(F.col(next(iter(counted))) > 0)


def worker_report(log: DataFrame, worker: str, value: str) -> DataFrame:
    """Items, total and mean of each worker, and of all of them in a row named Total."""
    rolled = log.groupBy(worker).agg(F.count("*").alias("items"), F.sum(value).alias("total"))
    whole = rolled.agg(F.sum("items").alias("items"), F.sum("total").alias("total")).select(F.lit("Total").alias("worker"), "items", "total")
    rows = rolled.select(F.col(worker).cast("string").alias("worker"), "items", "total").unionByName(whole)
    return rows.withColumn("mean", F.col("total") / F.col("items"))
