"""Admission of links over time: a link is let in when its last admission is longer ago than the ttl.

The batch form scans sorted events with one number per key as its state; the
streaming form keeps the same number in keyed state. Both give the same rows.
Event times are milliseconds; events of a key that come late, before its last
admission, are never let in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom import schema


def admit_log(events: DataFrame, key: str, at_ms: str, ttl_ms: int = schema.DEFAULT_TTL_MS) -> DataFrame:
    """(key, at_ms) of the admitted events; events of one key and time are one. Null keys are never admitted."""
    rows = events.where(F.col(key).isNotNull() & F.col(at_ms).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(at_ms).cast("long").alias("at_ms")).distinct()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            keep = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != now:
                    now, last = k, None
                keep.append(last is None or t - last > ttl_ms)
                if keep[-1]:
                    last = t
            yield batch.filter(pa.array(keep, pa.bool_()))

    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "at_ms").mapInArrow(scan, "key string, at_ms long")


def admit_stream(events: DataFrame, key: str, at_ms: str, ttl_ms: int = schema.DEFAULT_TTL_MS) -> DataFrame:
    """The same over a stream, in append mode; the state of a key is its last admission."""
    rows = events.where(F.col(key).isNotNull() & F.col(at_ms).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(at_ms).cast("long").alias("at_ms"))

    def step(name, frames, state):
        import pandas as pd

        last = state.get[0] if state.exists else None
        out = []
        times = sorted({int(t) for f in frames for t in f["at_ms"]})
        for t in times:
            if last is None or t - last > ttl_ms:
                out.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"key": [name[0]] * len(out), "at_ms": out})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, at_ms long", "last long", "append", "NoTimeout")


def latest_visits(events: DataFrame, key: str, at_ms: str) -> DataFrame:
    """Crawl states of a log: the last visit of each key."""
    return events.groupBy(F.col(key).cast("string").alias("path")).agg(F.max(at_ms).alias("last_processed_ms"))


def each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``action`` on every micro-batch of what is there now; batch numbers let it skip one it has seen."""
    query = stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def publish_stream(pages: DataFrame, store, checkpoint: str):
    """Staged pages of a stream become commits of the store, one per micro-batch.

    ``pages`` has the columns of pages, and ``links``. A commit writes the batch and the
    edges it completes: its own links to known pages, and links of earlier pages that
    waited for a page of the batch. Of rows with equal path the largest unique_id
    counts, then the largest title.
    """
    return each_batch(pages, lambda batch, number: publish_batch(batch, store), checkpoint)


def publish_batch(batch: DataFrame, store) -> None:
    """One micro-batch as a commit; a batch that comes again replaces its own rows by equal ones."""
    from linkloom.operators import graph
    from linkloom.operators.store import Delta
    from linkloom.scratch import release, written

    names = [*schema.PAGES.fieldNames(), "links"]
    row = F.max_by(F.struct(*names), F.struct("unique_id", "title")).alias("row")
    new = written(batch.groupBy("path").agg(row).select(*[F.col(f"row.{n}").alias(n) for n in names]), "staged")
    own = graph.explode_links(new).distinct()
    # only pages that links of the batch lead to, and only links that wait for a page of the batch
    known = store.lookup("pages", own.select("dst_path")).select("path").unionByName(new.select("path")).distinct()
    late = store.lookup("waiting", new.select("path")).join(new.select(F.col("path").alias("src_path")), "src_path", "left_anti")
    late = graph.complete_edges(late, new)
    late = late.join(store.lookup("edges", late.select("src")), ["src", "dst"], "left_anti")
    touched = new.select("path")
    store.commit(
        pages=new,
        raw_links=Delta(own, touched.withColumnRenamed("path", "src_path")),
        edges=Delta(graph.resolved_edges(own, known).unionByName(late), touched.withColumnRenamed("path", "src")),
    )
    release(new)
