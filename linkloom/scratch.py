"""Tables written to the shared folder, which cut a plan's lineage in a way that survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables that ``written`` returned and nothing has released yet.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names, as a full URI; a temporary one only where none is set on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/linkloom-scratch"
        spark.conf.set("spark.checkpoint.dir", folder)
    return qualified(spark, folder).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme: one without belongs to the cluster's default file system, not to any machine's disk."""
    files, where = filesystem(spark, path)
    whole = where.makeQualified(files.getUri(), files.getWorkingDirectory()).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    files, where = filesystem(spark, path)
    files.delete(where, True)


#: Folders that are there until the interpreter ends, with the sessions that made them.
_left: dict[str, weakref.ref] = {}


@atexit.register
def _remove_left() -> None:
    for path, made_by in _left.items():
        spark = made_by()
        if spark is not None and spark.sparkContext._jsc is not None:
            try:
                remove(spark, path)
            except Exception:  # noqa: BLE001  the session may be gone when the interpreter ends
                pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder, deleted when the interpreter ends."""
    path = f"{shared_dir(spark)}/linkloom/{name}-{uuid.uuid4().hex}"
    _left[path] = weakref.ref(spark)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows written as Parquet and read back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[back] = path
    return back


def release(*tables: DataFrame | str | None) -> None:
    """Deletes the folders behind written tables (or named folders) that no later plan reads; others are left alone."""
    for table in tables:
        if isinstance(table, DataFrame):
            path = _folders.pop(table, None)
            if path is not None:
                _left.pop(path, None)
                remove(table.sparkSession, path)
        elif table is not None:
            _left.pop(table, None)
            remove(SparkSession.active(), table)
