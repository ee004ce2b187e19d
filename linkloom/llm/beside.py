"""Rows known by file and row number, and tables that tasks read beside the rows they scan.

A join that brings a few facts to large texts would shuffle the texts. Here the
facts are written in folders by input file, sorted by row, in the shared folder;
a task that scans texts reads the facts of its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import releasing, scratch_path, written

#: Row number within its file: so many low bits of a row's id.
ROW_BITS = 40
#: Rows of a batch that are taken up together with what stands beside them.
RUN = 1_000
ROWS = "rid long, doc long, text string"


def has_files(docs: DataFrame) -> bool:
    try:
        docs.select("_metadata.row_index").schema  # noqa: B018  asks the analyzer
    except AnalysisException:
        return False
    return True


def file_numbers(docs: DataFrame):
    """A number for each input file, broadcast: a name for each file that the scan lists."""
    files = sorted(r[0] for r in docs.select(F.col("_metadata.file_path")).distinct().toLocalIterator())
    return docs.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(files)})


def rids_of(paths: pa.Array, rows: pa.Array, numbers: dict[str, int]) -> list[int]:
    of = {f: numbers[f] << ROW_BITS for f in paths.unique().to_pylist()}
    return [of[f] + r for f, r in zip(paths.to_pylist(), rows.to_pylist())]


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` read from files, and its rows as (rid, doc, text); a table that no file holds is written first."""
    if not has_files(docs):
        docs = written(docs, "documents")
    numbers = file_numbers(docs)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = rids_of(batch.column(0), batch.column(1), numbers.value)
            yield pa.record_batch([pa.array(rids, pa.int64()), *batch.columns[2:]], names=["rid", "doc", "text"])

    doc = F.col("doc_id").cast("long").alias("doc")
    return docs, docs.select(F.col("_metadata.file_path"), F.col("_metadata.row_index"), doc, "text").mapInArrow(releasing(number), ROWS)


class Beside:
    """A table written by ``write_beside``, read by row range within a task.

    Footers of an input file's parts are read once in a task; of the parts, only row
    groups that overlap a batch's rows.
    """

    def __init__(self, path: str):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(path)
        self.groups: dict[int, list[tuple[int, int, str, object, int]]] = {}

    def _of(self, file: int) -> list[tuple[int, int, str, object, int]]:
        """(least rid, largest rid, part, footer, row group) of an input file's parts."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        if file not in self.groups:
            found = []
            for info in self.store.get_file_info(fs.FileSelector(f"{self.root}/file={file}", allow_not_found=True)):
                if info.path.endswith(".parquet"):
                    footer = pq.read_metadata(info.path, filesystem=self.store)
                    at = footer.schema.names.index("rid")
                    for g in range(footer.num_row_groups):
                        span = footer.row_group(g).column(at).statistics
                        found.append((span.min, span.max, info.path, footer, g))
            self.groups[file] = found
        return self.groups[file]

    def rows(self, rids: list[int]) -> pa.Table | None:
        """The rows written for the range of ids that a batch spans, sorted by rid; None where there are none."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        parts = []
        span: dict[int, list[int]] = {}
        for r in rids:
            k = r >> ROW_BITS
            a = span.get(k)
            span[k] = [r, r] if a is None else [min(a[0], r), max(a[1], r)]
        for k, (lo, hi) in span.items():
            wanted: dict[str, tuple[object, list[int]]] = {}
            for least, largest, path, footer, g in self._of(k):
                if least <= hi and largest >= lo:
                    wanted.setdefault(path, (footer, []))[1].append(g)
            for path, (footer, groups) in wanted.items():
                with self.store.open_input_file(path) as source, pq.ParquetFile(source, metadata=footer) as part:
                    table = part.read_row_groups(groups, use_threads=False)
                table = table.filter(pc.and_(pc.greater_equal(table["rid"], lo), pc.less_equal(table["rid"], hi)))
                if len(table):
                    parts.append(table)
        return pa.concat_tables(parts).sort_by("rid") if parts else None


#: Rows of an input file, by powers of two, whose side rows one task writes.
CHUNK_BITS = 16


def write_beside(rows: DataFrame, name: str) -> str:
    """Writes rows with a ``rid`` for Beside, in folders by file, sorted by row; returns the folder.

    Each chunk of an input file's rows goes to one task, so a folder holds no more
    parts than its file has chunks, whatever the number of tasks.
    """
    path = scratch_path(rows.sparkSession, name)
    placed = rows.withColumn("file", F.shiftright("rid", ROW_BITS))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(n, "file", F.shiftright("rid", CHUNK_BITS)).sortWithinPartitions("file", "rid")
    placed.write.option("compression", "zstd").option("parquet.block.size", 1 << 20).partitionBy("file").parquet(path)
    return path


def kept_rows(docs: DataFrame, keep: DataFrame, drop: bool = False) -> DataFrame:
    """The rows of ``docs`` (read from files) whose rid is in ``keep``, or with ``drop`` is not, with their own columns; texts are not shuffled."""
    path = write_beside(keep.select("rid"), "keep")
    names, numbers = docs.columns, file_numbers(docs)
    inner = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Beside(path)
        for batch in batches:
            rids = rids_of(batch.column("f"), batch.column("r"), numbers.value)
            found = beside.rows(rids)
            wanted = set(found["rid"].to_pylist()) if found is not None else set()
            yield batch.filter(pa.array([(r in wanted) != drop for r in rids], pa.bool_())).select(range(len(names)))

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return inner.mapInArrow(releasing(choose), schema).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def runs_with(batches: Iterator[pa.RecordBatch], beside: Beside) -> Iterator[tuple[pa.RecordBatch, object, pa.Table]]:
    """Runs of at most RUN rows (rid first) that have rows beside them: the run, the place in it of each found row, the found rows."""
    import numpy as np

    for batch in batches:
        found = beside.rows(batch.column(0).to_pylist())
        if found is None:
            continue
        have = found["rid"].to_numpy()
        for at in range(0, batch.num_rows, RUN):
            run = batch.slice(at, RUN)
            rids = run.column(0).to_numpy()
            lo, hi = np.searchsorted(have, rids.min(), "left"), np.searchsorted(have, rids.max(), "right")
            order = np.argsort(rids)
            place = np.minimum(np.searchsorted(rids[order], have[lo:hi]), len(rids) - 1)
            own = rids[order][place] == have[lo:hi]
            if own.any():
                yield run, order[place[own]], found.slice(lo, hi - lo).filter(pa.array(own))


def beside_texts(texts: DataFrame, rows: DataFrame, names: list[str], name: str, carry: list[str] | None = None) -> DataFrame:
    """``rows`` (rid and the named columns) with the text of each: an inner join that moves only the texts it finds.

    ``texts`` has rid, a second column and the text; ``carry`` names the second column if it is wanted as well.
    """
    path = write_beside(rows.select("rid", *names), name)
    kinds = dict(rows.dtypes)
    more = carry or []

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, of, found in runs_with(batches, Beside(path)):
            place = pa.array(of)
            own = [run.column(1).take(place)] * len(more) + [run.column(2).take(place)]
            yield from pa.table([*(found[n] for n in names), *own], names=[*names, *more, "text"]).combine_chunks().to_batches()

    return texts.mapInArrow(releasing(look), ", ".join([*(f"{n} {kinds[n]}" for n in names), *(f"{n} long" for n in more), "text string"]))
