"""Streams with state per link: links that fall due by timer, and edges that wait for their page.

Both need the RocksDB state store, which ``rocksdb`` sets for the session: state then
lies on disk and in checkpoints, and grows with the links that are known, not with the
memory of an executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linkloom import schema

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts that the links to one target are dealt to, so that a target of very many links is not one task's.
SALTS = 8


class rocksdb:
    """Within this block new streams of the session keep their state in RocksDB."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self):
        self.had = self.conf.get(PROVIDER, None)
        self.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_):
        self.conf.unset(PROVIDER) if self.had is None else self.conf.set(PROVIDER, self.had)


def _texts(values: list) -> pd.Series:
    """A column of Python strings: what comes back from a processor has to be that, whatever pandas makes of strings."""
    return pd.Series(values, dtype=object)


class _Due(StatefulProcessor):
    """A link's last visit, and a timer for the moment after which it is due."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        first, due = last, []
        # a late visit, before one that is known, is none
        for at in sorted({int(t) for part in rows for t in part["at_ms"]}):
            if last is not None and at - last > self.ttl_ms:
                due.append(last + self.ttl_ms + 1)  # the timer would have rung between the two
            if last is None or at > last:
                last = at
        if last != first:
            if first is not None:
                self.handle.deleteTimer(first + self.ttl_ms + 1)
            self.last.update((last,))
            self.handle.registerTimer(last + self.ttl_ms + 1)
        yield pd.DataFrame({"path": _texts([key[0]] * len(due)), "due_ms": pd.Series(due, dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()  # the link is handed out; its next visit begins anew
        yield pd.DataFrame({"path": _texts([key[0]]), "due_ms": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def due_links(visits: DataFrame, ttl_ms: int = schema.DEFAULT_TTL_MS, delay: str = "0 seconds") -> DataFrame:
    """(path, due_ms): each link when the ttl has passed since its last visit; a visit before then puts it off.

    ``visits`` is a stream of (path, at: timestamp). Time is that of the visits: a timer
    rings once the watermark has passed it, and takes its link's state along, so only
    links that are not due are remembered. Null paths and times are never due.
    """
    rows = visits.where("path is not null and at is not null").withWatermark("at", delay)
    rows = rows.select(F.col("path").cast("string").alias("path"), "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("path").transformWithStateInPandas(_Due(ttl_ms), "path string, due_ms long", "Append", "eventTime")


def late_edges(links: DataFrame, pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """(src, dst): each stated link once its target has a page, whichever comes first and however much later.

    ``links`` is a stream of (src_path, dst_path), ``pages`` one of (path). Both are freed
    of repeats and joined, all of it by Spark's own stateful operators, so no row passes
    Python; a repeated link or page gives no further edge. Links to one target are dealt
    to ``salts`` parts by their source, and its page is told to each of them.
    """
    stated = links.where("src_path is not null and dst_path is not null").select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))
    stated = stated.dropDuplicates(["src", "dst"]).withColumn("salt", F.pmod(F.xxhash64("src"), F.lit(salts)).cast("int"))
    come = pages.where("path is not null").select(F.col("path").alias("dst")).dropDuplicates(["dst"])
    come = come.select("dst", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return stated.join(come, ["dst", "salt"]).select("src", "dst")
