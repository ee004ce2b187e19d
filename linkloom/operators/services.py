"""What callers ask of pages and of links, over one GraphStore.

Each method is one plan over the store's last commit; nothing is kept in memory, so
the two services and a crawl may share a store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom import schema
from linkloom.operators import changes, graph
from linkloom.operators.store import Delta, GraphStore


class Pages:
    def __init__(self, store: GraphStore):
        self.store = store

    def all(self) -> DataFrame:
        return self.store.read("pages")

    def by_title(self, title: str) -> DataFrame:
        """The pages that have a title now, by the index of titles; the pages are not scanned."""
        paths = self.store.lookup("titles", [title]).select("path")
        return self.store.lookup("pages", self.store.few(paths))

    def by_titles(self, arguments: DataFrame) -> DataFrame:
        """(position, title, path) for a table of titles, none if one is unknown; of pages that share a title the last written counts."""
        paths = self.store.lookup("titles", arguments.select("title")).select("path")
        return graph.resolve_titles(self.store.lookup("pages", paths), arguments)

    def by_id(self, unique_id: int) -> DataFrame:
        return graph.page_by_id(self.all(), unique_id)

    def by_path(self, path: str) -> DataFrame:
        return self.store.lookup("pages", [path])

    def within(self, paths: DataFrame) -> DataFrame:
        return self.store.lookup("pages", paths.select("path"))

    def count(self) -> int:
        return self.all().count()

    def next_id(self) -> int:
        return self.all().agg(F.coalesce(F.max("unique_id"), F.lit(-1))).first()[0] + 1

    def neighbours(self, path: str) -> DataFrame:
        return self.store.lookup("pages", self.store.lookup("edges", [path]).select("dst"))

    def waiting_for(self, path: str) -> DataFrame:
        """The pages that wait for a path to get a page, by the index of waiting links."""
        return self.store.lookup("pages", self.store.lookup("waiting", [path]).select("src_path"))

    def stating(self, path: str) -> DataFrame:
        """The pages that state a link to a path, whether or not it has a page; all raw links are read."""
        stated = self.store.read("raw_links").where(F.col("dst_path") == path)
        return self.within(stated.select(F.col("src_path").alias("path")))

    def pending(self) -> DataFrame:
        """(dst_path, sources): for each path without a page, the pages that wait for it."""
        return graph.pending_sources(self.store.read("waiting"))

    def insert(self, pages: DataFrame) -> int:
        """Adds pages, or replaces those of their paths."""
        return self.store.commit(pages=pages)

    def create_bare(self, pages: DataFrame) -> int:
        """Adds pages without links; those whose path has a page are left out."""
        new = pages.join(self.within(pages).select("path"), "path", "left_anti")
        return self.store.commit(pages=Delta(new, adds=True))

    def save(self, changed: DataFrame) -> int:
        """Columns that are not null replace those of stored pages; nothing is added."""
        stored = self.within(changed)
        return self.store.commit(pages=changes.save(stored, changed))

    def clear_out_edges(self, paths: DataFrame) -> int:
        return self.store.commit(edges=Delta(replaced=paths.select(F.col("path").alias("src"))))


class Links:
    def __init__(self, store: GraphStore, ttl_ms: int = schema.DEFAULT_TTL_MS):
        self.store, self.ttl_ms = store, ttl_ms

    def all(self) -> DataFrame:
        return self.store.read("links")

    def by_path(self, path: str) -> DataFrame:
        """The state of a link; no row where it has none (nothing is made)."""
        return self.store.lookup("links", [path])

    def within(self, paths: DataFrame) -> DataFrame:
        return self.store.lookup("links", paths.select("path"))

    def get_or_make(self, paths: DataFrame) -> DataFrame:
        return changes.get_or_make_links(self.within(paths), paths)

    def create(self, paths: DataFrame) -> int:
        """Adds default states for paths that have none."""
        wanted = paths.select("path").distinct()
        new = wanted.join(self.within(wanted).select("path"), "path", "left_anti")
        return self.store.commit(links=Delta(changes.default_links(new), adds=True))

    def update(self, states: DataFrame) -> int:
        return self.store.commit(links=states)

    def delete(self, paths: DataFrame) -> int:
        return self.store.commit(links=Delta(replaced=paths))

    def before(self, ms: int) -> DataFrame:
        return changes.stale_links(self.all(), ms)

    def due(self, paths: DataFrame, now_ms: int) -> DataFrame:
        """(path, due): whether each path may be visited now; a path without a state may."""
        return self.get_or_make(paths).select("path", changes.is_due(now_ms, self.ttl_ms).alias("due"))

    def count(self) -> int:
        return self.all().count()

    def urls(self) -> DataFrame:
        """(path, locales) as last written."""
        return self.store.read("urls")

    def put_urls(self, urls: DataFrame) -> int:
        return self.store.commit(urls=urls)
