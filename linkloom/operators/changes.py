"""Change detection, upserts, tombstones and crawl-state transitions as whole-table joins.

Tables are immutable snapshots: each function returns the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import schema

SCALARS = ("title", "description", "is_redirect", "article_type")


def upsert(existing: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """New rows replace those of equal key; others are added."""
    return existing.join(new.select(key), key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """The first writer of a key wins."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(*existing.columns))


def delete(existing: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    return existing.join(keys.select(key), key, "left_anti").select(*existing.columns)


def save(existing: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Columns of ``new`` that are not null replace those of stored rows; the key never changes, nothing is added."""
    names = [c for c in new.columns if c != key]
    joined = existing.join(new.select(key, *[F.col(c).alias(f"__{c}") for c in names]), key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in existing.columns])


def link_sets_differ(new_links: Column, neighbours: Column) -> Column:
    """Another number of links, or one that is no neighbour; links that point nowhere yet therefore always count as a change."""
    new, old = (F.coalesce(c, F.array().cast("array<string>")) for c in (new_links, neighbours))
    return (F.size(new) != F.size(old)) | (F.size(F.array_except(new, old)) > 0)


def page_changes(stored: DataFrame, incoming: DataFrame, columns: tuple[str, ...] = SCALARS) -> DataFrame:
    """Incoming rows with ``action`` (create or update) and ``changed``: any compared column differs, nulls being equal to nulls.

    ``is_removed`` is neither compared nor reset. Where both sides have an array
    ``links`` (stored: neighbours), it takes part by link_sets_differ.
    """
    old = stored.select("path", F.lit(True).alias("__stored"), *[F.col(c).alias(f"__{c}") for c in (*columns, *(["links"] if "links" in stored.columns else []))])
    joined = incoming.join(old, "path", "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    if "links" in stored.columns and "links" in incoming.columns:
        differs = differs | link_sets_differ(F.col("links"), F.col("__links"))
    action = F.when(F.col("__stored").isNull(), "create").otherwise("update")
    return joined.select(*incoming.columns, action.alias("action"), differs.alias("changed"))


def relink(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Out-edges of changed pages (column ``src``) give way to fresh ones."""
    return clear_out_edges(edges, changed).unionByName(fresh.select("src", "dst")).distinct()


def clear_out_edges(edges: DataFrame, changed: DataFrame) -> DataFrame:
    return edges.join(changed.select("src").distinct(), "src", "left_anti").select("src", "dst")


def retitle(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """New titles by path."""
    return save(pages, titles.select("path", "title"))


def tombstones(pages: DataFrame, failed: DataFrame, resurrect: DataFrame | None = None) -> DataFrame:
    """Pages among ``failed`` paths become removed; their in-edges stay. Removal is kept unless ``resurrect`` names a path."""
    gone = failed.select("path", F.lit(True).alias("__gone")).distinct()
    out = pages.join(gone, "path", "left")
    flag = F.coalesce("__gone", "is_removed", F.lit(False))
    if resurrect is not None:
        out = out.join(resurrect.select("path", F.lit(True).alias("__back")).distinct(), "path", "left")
        flag = F.when(F.col("__gone").isNull() & F.col("__back").isNotNull(), False).otherwise(flag)
    return out.withColumn("is_removed", flag).select(*pages.columns)


# -- crawl state --------------------------------------------------------------


def default_links(paths: DataFrame) -> DataFrame:
    """States of links that were never visited; ids follow from the path, so they are the same in every run."""
    return paths.select(
        "path",
        F.sha2("path", 256).alias("link_id"),
        F.lit(False).alias("processed"),
        F.lit(False).alias("registered"),
        F.lit(False).alias("page_found"),
        F.lit(schema.NEVER).cast("long").alias("last_processed_ms"),
    )


def get_or_make_links(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """The state of each wanted path: as stored, or new."""
    made = default_links(wanted.select("path").distinct())
    names = [c for c in made.columns if c != "path"]
    joined = made.join(links.select("path", *[F.col(c).alias(f"__{c}") for c in names]), "path", "left")
    return joined.select("path", *[F.coalesce(f"__{c}", c).alias(c) for c in names])


def is_due(now_ms: Column | int, ttl_ms: int = schema.DEFAULT_TTL_MS) -> Column:
    """Not registered, and last visited strictly more than the ttl ago; a link without state is due."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return F.coalesce(~F.col("registered") & (now - F.col("last_processed_ms") > ttl_ms), F.lit(True))


def stale_links(links: DataFrame, before_ms: Column | int) -> DataFrame:
    """Visited strictly before a time."""
    return links.where(F.col("last_processed_ms") < before_ms)


def mark_processed(links: DataFrame, visited: DataFrame, now_ms: int) -> DataFrame:
    """``visited`` has path and page_found: their states become processed, not registered, visited now."""
    seen = visited.select("path", F.col("page_found").alias("__found"))
    joined = links.join(seen, "path", "left")
    hit = F.col("__found").isNotNull()
    return joined.select(
        "path",
        "link_id",
        (hit | F.col("processed")).alias("processed"),
        (~hit & F.col("registered")).alias("registered"),
        F.coalesce("__found", "page_found").alias("page_found"),
        F.when(hit, F.lit(now_ms).cast("long")).otherwise(F.col("last_processed_ms")).alias("last_processed_ms"),
    )


def register(links: DataFrame, admitted: DataFrame) -> DataFrame:
    """Admitted links are marked before they are queued."""
    marked = links.join(admitted.select("path", F.lit(True).alias("__in")).distinct(), "path", "left")
    return marked.withColumn("registered", F.coalesce("__in", "registered")).select(*links.columns)


def deregister_queued(links: DataFrame, queued: DataFrame) -> DataFrame:
    """What still waits at shutdown is free again."""
    marked = links.join(queued.select("path", F.lit(False).alias("__out")).distinct(), "path", "left")
    return marked.withColumn("registered", F.coalesce("__out", "registered")).select(*links.columns)


def fetch_routes(fetched: DataFrame) -> DataFrame:
    """Where each fetch goes: ``parse``, ``unlink`` (gone for good) or ``stash`` (try again when due)."""
    route = (
        F.when(F.col("status") == schema.SUCCESS, "parse")
        .when(F.col("status") == schema.DOES_NOT_EXIST, "unlink")
        .when(F.col("status") == schema.CONNECTION_ERROR, "stash")
    )
    return fetched.withColumn("route", route)
