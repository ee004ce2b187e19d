"""What several operators of the subpackage share."""

from __future__ import annotations

from linkloom.scratch import new_path as scratch_path
from linkloom.scratch import release, written

__all__ = ["AT_END", "release", "releasing", "scratch_path", "written"]


#: Called at the end of a task: empties what a module keeps for the rows of one task.
AT_END: list = []


def release_memory() -> None:
    """Gives back to the system what this worker holds but no longer uses: workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    for forget in AT_END:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not with this C library
        pass


def releasing(task):
    """A task over batches that gives its memory back when it ends."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run
