"""The graph's tables in a folder: a base and deltas, named by numbered commits.

A commit writes only what changed: new rows, and for tables whose rows replace
earlier ones the keys they replace. Readers merge: a row counts unless a later part
replaces its key. A part that has grown to the size of those before it is merged with
them, so there are only a logarithmic number of parts and each row is rewritten as often.

Each table is one Spark table, bucketed and sorted by its key, with a partition for
each part, which the session's catalog knows by a name made of the folder. So Spark
knows where a key lies: ``lookup`` by a list of keys opens the files of their buckets
alone (and within them, as rows are sorted, the pages whose statistics fit), and by a
table of keys it is a join that shuffles the keys and not the stored rows.

Two tables are indexes that commits keep up: ``titles`` (which paths have a title) and
``waiting`` (which pages state a link whose target has no page). Their rows carry +1 or
-1, and a pair counts while its sum is positive, so an entry is retracted without
reading where it was made.

A commit becomes visible by one small file that names its parts, written under
another name and renamed: readers see the tables of one commit, and a writer that
dies leaves nothing that counts. One writer at a time is assumed; on stores whose
rename is a copy, a second writer is only noticed if it comes after that copy.
``vacuum`` drops what no commit needs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import schema
from linkloom.scratch import filesystem, remove

#: Tables, and the column whose values a commit's rows replace; None: rows are only added.
TABLES = {
    "pages": (schema.PAGES, "path"),
    "links": (schema.LINKS, "path"),
    "urls": (schema.URLS, "path"),
    "raw_links": (schema.RAW_LINKS, "src_path"),
    "edges": (schema.EDGES, "src"),
    "visits": (schema.VISITS, None),
    "titles": (schema.TITLES, "title"),
    "waiting": (schema.WAITING, "dst_path"),
}
#: Tables whose rows count by the sum of ``n`` over rows that are else equal.
SIGNED = ("titles", "waiting")
#: Parts of a table from which on the last ones are merged.
PARTS = 8
#: Buckets of a new store's tables: few, as for a small one. One of some TB wants thousands, so that a bucket is a few files of good size.
BUCKETS = 4
#: Keys up to which a lookup names them one by one, so that Spark opens their buckets alone.
LISTED = 1000
VERSION = "__v"


@dataclass
class Delta:
    """Rows that a commit adds to a table, and what they replace.

    ``replaced`` has the table's key column: earlier rows of these keys are gone. None:
    the keys of ``rows`` are; ``adds`` True: nothing is.
    """

    rows: DataFrame | None = None
    replaced: DataFrame | None = None
    adds: bool = False


class GraphStore:
    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS, buckets: int = BUCKETS):
        self.spark, self.folder, self.parts, self.buckets = spark, folder.rstrip("/"), parts, buckets
        self._made: set[str] = set()
        self._making = Lock()

    # -- versions -------------------------------------------------------------

    def versions(self) -> list[int]:
        files, where = filesystem(self.spark, f"{self.folder}/commits")
        if not files.exists(where):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(where) if s.getPath().getName().isdigit())

    def _commit_file(self, version: int | None = None) -> dict:
        """What a commit (the last by default) has written: how many buckets the store has, and its tables."""
        known = self.versions()
        if not known:
            return {"buckets": self.buckets, "tables": {}}
        files, where = filesystem(self.spark, f"{self.folder}/commits/{known[-1] if version is None else version}")
        stream = files.open(where)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _manifest(self, version: int | None = None) -> dict[str, list[dict]]:
        """Per table its parts, oldest first: number, whether it has rows, what it replaces (keys that are listed, those of its own rows, none), bytes."""
        return self._commit_file(version)["tables"]

    def _publish(self, version: int, manifest: dict) -> None:
        files, draft = filesystem(self.spark, f"{self.folder}/commits/.{version}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not files.rename(draft, filesystem(self.spark, f"{self.folder}/commits/{version}")[1]):
            raise RuntimeError(f"commit {version} was taken by another writer")

    # -- reading --------------------------------------------------------------

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as of a commit (the last by default); empty before the first."""
        return self._live(table, self._manifest(version).get(table, []))

    def lookup(self, table: str, keys: DataFrame | Sequence, version: int | None = None) -> DataFrame:
        """The rows of some keys: a list of them, or a table whose first column they are."""
        key = TABLES[table][1]
        if isinstance(keys, DataFrame):
            wanted = keys.select(F.col(keys.columns[0]).alias(key))
            return self._live(table, self._manifest(version).get(table, []), lambda rows: rows.join(wanted, key, "left_semi"))
        return self._live(table, self._manifest(version).get(table, []), lambda rows: rows.where(F.col(key).isin(list(keys))))

    def few(self, keys: DataFrame) -> DataFrame | list:
        """Keys (one column) for ``lookup``: listed if they are few, which prunes buckets, else as they are, which joins."""
        found = keys.distinct().limit(LISTED + 1).collect()
        return [r[0] for r in found] if len(found) <= LISTED else keys

    def _live(self, table: str, parts: list[dict], narrow: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        rows = self._merged(table, parts, narrow).drop(VERSION)
        if table in SIGNED:
            names = [n for n in rows.columns if n != "n"]
            rows = rows.groupBy(*names).agg(F.sum("n").alias("n")).where("n > 0").select(*names, F.lit(1).cast("long").alias("n"))
        return rows

    def _table(self, table: str, of: str) -> str:
        """The name of the Spark table of a table's rows or replaced keys, made where the session does not know it yet."""
        kind, key = TABLES[table]
        where = f"{self.folder}/{table}/{of}"
        name = f"linkloom_{hashlib.md5(where.encode()).hexdigest()}"
        with self._making:
            if name not in self._made:
                names = kind.fieldNames() if of == "rows" else [key]
                ddl = ", ".join(f"{n} {kind[n].dataType.simpleString()}" for n in names)
                dealt = f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self._buckets()} BUCKETS" if key else ""
                self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}, {VERSION} int) USING parquet PARTITIONED BY ({VERSION}) {dealt} LOCATION '{where}'")
                files, folder = filesystem(self.spark, where)
                if files.exists(folder):
                    self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
                self._made.add(name)
        return name

    def _buckets(self) -> int:
        """As many as the store was made with."""
        return self._commit_file()["buckets"]

    def _merged(self, table: str, parts: list[dict], narrow: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        kind, key = TABLES[table]
        names = kind.fieldNames()
        at = {of: [p["v"] for p in parts if test(p)] for of, test in (("rows", lambda p: p["rows"]), ("own", lambda p: p["replaces"] == "own"), ("keys", lambda p: p["replaces"] == "keys"))}
        read = lambda of, versions: narrow(self.spark.table(self._table(table, of)).where(F.col(VERSION).isin(versions)))
        if not at["rows"]:
            # known to be empty when it is planned, so what joins it is left out; rows from Python would be a job
            return self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind], F.lit(0).alias(VERSION)).where("false")
        rows = read("rows", at["rows"])
        # what is first cannot replace anything
        first = parts[0]["v"]
        replacing = [read(of, v).select(key, VERSION) for of, v in (("rows", [v for v in at["own"] if v > first]), ("keys", [v for v in at["keys"] if v > first])) if v]
        if not replacing:
            return rows
        keys = replacing[0] if len(replacing) == 1 else replacing[0].unionByName(replacing[1])
        last = keys.groupBy(key).agg(F.max(VERSION).alias("__last"))
        return rows.join(last, key, "left").where(F.col("__last").isNull() | (F.col(VERSION) >= F.col("__last"))).select(*names, VERSION)

    # -- writing --------------------------------------------------------------

    def _save(self, table: str, of: str, rows: DataFrame, part: int) -> int:
        """Rows or keys as a partition of their table; its bytes."""
        key, name = TABLES[table][1], self._table(table, of)
        where = f"{self.folder}/{table}/{of}/{VERSION}={part}"
        self._drop(table, of, part)  # of a writer that died
        names = [c for c in self.spark.table(name).columns if c != VERSION]
        rows = rows.select(*names, F.lit(part).alias(VERSION))
        # dealt by the key first, so that a bucket is one file and not one of each task
        (rows.repartition(key) if key else rows).write.insertInto(name)
        files, folder = filesystem(self.spark, where)
        return files.getContentSummary(folder).getLength() if files.exists(folder) else 0

    def _drop(self, table: str, of: str, part: int) -> None:
        files, folder = filesystem(self.spark, f"{self.folder}/{table}/{of}/{VERSION}={part}")
        if files.exists(folder):
            self.spark.sql(f"ALTER TABLE {self._table(table, of)} DROP IF EXISTS PARTITION ({VERSION} = {part})")
            files.delete(folder, True)

    def _drop_parts(self, manifest: dict, kept: set) -> None:
        for table, p in _parts(manifest):
            if (table, p["v"]) not in kept:
                for of in ("rows", "keys"):
                    self._drop(table, of, p["v"])

    def _write(self, table: str, part: int, delta: Delta) -> dict:
        key = TABLES[table][1]
        found = {"v": part, "rows": delta.rows is not None, "replaces": "none", "bytes": 0}
        if delta.rows is not None:
            found["bytes"] += self._save(table, "rows", delta.rows, part)
        if delta.replaced is not None:
            found["replaces"] = "keys"
            found["bytes"] += self._save(table, "keys", delta.replaced.select(key).distinct(), part)
        elif key is not None and not delta.adds and delta.rows is not None:
            found["replaces"] = "own"
        return found

    def commit(self, **deltas: Delta | DataFrame | None) -> int:
        """Adds deltas to tables, all of them visible at once; a DataFrame alone replaces the rows of its own keys.

        The indexes follow from the pages and raw links among them, unless a delta of
        theirs is given (None: nothing of it changes).
        """
        version = (self.versions() or [-1])[-1] + 1
        manifest = self._manifest()
        changes = {name: d if isinstance(d, Delta) or d is None else Delta(d) for name, d in deltas.items()}
        if "titles" not in changes and changes.get("pages") is not None:
            changes["titles"] = self._titles(changes["pages"])
        if "waiting" not in changes and changes.get("raw_links") is not None:
            changes["waiting"] = self._waiting(changes["raw_links"], changes.get("pages"))
        changes = {name: d for name, d in changes.items() if d is not None}
        # the tables are small jobs that wait more than they work, so they are written side by side
        with ThreadPoolExecutor(max(1, len(changes))) as pool:
            parts = dict(zip(changes, pool.map(lambda x: self._write(x[0], 2 * version, x[1]), changes.items())))
        for name, part in parts.items():
            manifest[name] = self._compacted(name, 2 * version + 1, [*manifest.get(name, []), part])
        self._publish(version, {"buckets": self._buckets(), "tables": manifest})
        # a delta that was merged at once stands in no commit
        self._drop_parts({name: [part] for name, part in parts.items()}, {(name, p["v"]) for name, p in _parts(manifest)})
        return version

    def _titles(self, pages: Delta) -> Delta:
        """Which titles the pages of a delta gain, and which ones they had before."""
        rows = pages.rows if pages.rows is not None else self.spark.createDataFrame([], schema.PAGES)
        new = rows.select("title", "path", F.lit(1).cast("long").alias("n"))
        touched = rows.select("path") if pages.replaced is None else pages.replaced.select("path")
        old = self.lookup("pages", touched).select("title", "path", F.lit(-1).cast("long").alias("n"))
        if pages.adds and pages.replaced is None:
            old = old.limit(0)  # nothing is replaced
        moved = new.unionByName(old).where("title is not null").groupBy("title", "path").agg(F.sum("n").alias("n"))
        return Delta(moved.where("n <> 0"), adds=True)

    def _waiting(self, raw: Delta, pages: Delta | None) -> Delta:
        """Links that wait, or wait no longer, when raw links change and pages come."""
        pair = ["dst_path", "src_path"]
        gained = raw.rows.select(*pair).distinct() if raw.rows is not None else self.spark.createDataFrame([], "dst_path string, src_path string")
        touched = (raw.replaced if raw.replaced is not None else gained).select("src_path")
        before = self.lookup("raw_links", touched).select(*pair).distinct()
        new = gained.select(*pair, F.lit(1).cast("long").alias("n"))
        old = before.select(*pair, F.lit(-1).cast("long").alias("n"))
        moved = new.unionByName(old).groupBy(*pair).agg(F.sum("n").alias("n"))
        if raw.adds and raw.replaced is None:
            moved = moved.where("n > 0")  # nothing is replaced, so nothing is lost
        moved = moved.where("n <> 0")
        known = self.lookup("pages", moved.select("dst_path")).select("path")
        come = None
        if pages is not None and pages.rows is not None:
            come = pages.rows.select("path")
            known = known.unionByName(come)
        moved = moved.join(known.withColumnRenamed("path", "dst_path"), "dst_path", "left_anti")
        return Delta(moved, come.select(F.col("path").alias("dst_path")), adds=True) if come is not None else Delta(moved, adds=True)

    def _compacted(self, table: str, part: int, parts: list[dict]) -> list[dict]:
        """The parts, the last of them merged where there are too many: from the first one that is no larger than all after it."""
        if len(parts) <= self.parts:
            return parts
        after, first = parts[-1]["bytes"], len(parts) - 2
        for k in range(len(parts) - 2, -1, -1):
            if parts[k]["bytes"] <= 2 * after:
                first = k
            after += parts[k]["bytes"]
        old = parts[first:]
        kind, key = TABLES[table]
        rows = self._merged(table, old).drop(VERSION)
        if table in SIGNED:
            names = [n for n in kind.fieldNames() if n != "n"]
            rows = rows.groupBy(*names).agg(F.sum("n").alias("n")).where("n <> 0")
        keys = None
        if key is not None and first:
            for of, kinds in (("rows", "own"), ("keys", "keys")):
                versions = [p["v"] for p in old if p["replaces"] == kinds]
                if versions:
                    found = self.spark.table(self._table(table, of)).where(F.col(VERSION).isin(versions)).select(key)
                    keys = found if keys is None else keys.unionByName(found)
        return [*parts[:first], self._write(table, part, Delta(rows, keys, adds=True))]

    def vacuum(self, keep: int = 2) -> None:
        """Drops commits but the last ones, and parts that none of those names."""
        known = self.versions()
        manifests = {v: self._manifest(v) for v in known}
        used = {(name, p["v"]) for v in known[-keep:] for name, p in _parts(manifests[v])}
        for v in known[:-keep]:
            self._drop_parts(manifests[v], used)
        for v in known[:-keep]:
            remove(self.spark, f"{self.folder}/commits/{v}")

    # -- staging --------------------------------------------------------------

    def publish(self, staged: dict[str, DataFrame], action: Callable[[dict[str, DataFrame]], None] | None = None) -> int:
        """Drains staged tables into the store as one commit; ``action`` sees the rows before.

        Rows of keyed tables replace those of their keys; edges and raw links that are there already are not added again.
        """
        if action is not None:
            action(staged)
        deltas = {}
        for name, rows in staged.items():
            kind, _ = TABLES[name]
            if name in ("edges", "raw_links"):
                names = kind.fieldNames()
                wanted = rows.select(*names).distinct()
                deltas[name] = Delta(wanted.join(self.lookup(name, wanted), names, "left_anti"), adds=True)
            else:
                deltas[name] = Delta(rows)
        return self.commit(**deltas)


def _parts(manifest: dict) -> list[tuple[str, dict]]:
    return [(name, p) for name, parts in manifest.items() for p in parts]
