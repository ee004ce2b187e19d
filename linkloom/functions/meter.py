"""What a task's time goes into: waiting for rows, working on them, waiting until they are taken."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from time import perf_counter_ns

import pyarrow as pa
from pyspark.sql import types as T

#: Of each row: the task's partition, its own time, and the waits that it bears for its batch.
TIMES = T.StructType([T.StructField("worker", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("took_us", "starved_us", "blocked_us")])


def _with(rows: pa.RecordBatch, name: str, at: int, us: int) -> pa.RecordBatch:
    """``rows`` with one more column of microseconds, all of them in row ``at``."""
    column = [0] * rows.num_rows
    column[at] = us
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(column, pa.int64())], names=[*rows.schema.names, name])


def handed_over(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows with ``blocked_us``: the last one goes by itself and bears the time until the others were taken."""
    head, blocked = rows.num_rows - 1, 0
    if head > 0:
        began = perf_counter_ns()
        yield _with(rows.slice(0, head), "blocked_us", 0, 0)
        blocked = (perf_counter_ns() - began) // 1000
    if head >= 0:
        yield _with(rows.slice(head), "blocked_us", 0, blocked)


def metered(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``work`` on each batch, its rows with ``starved_us`` (the first one bears the wait for the batch) and ``blocked_us``."""
    batches, waited = iter(batches), 0
    while True:
        began = perf_counter_ns()
        batch = next(batches, None)
        if batch is None:
            return
        waited += (perf_counter_ns() - began) // 1000
        done = work(batch)
        if done.num_rows:
            yield from handed_over(_with(done, "starved_us", 0, waited))
            waited = 0
