"""Packing by power-of-two decomposition: a document is cut into binary-length pieces.

A piece is a sequence of its own, so no sequence crosses documents and none needs
padding. Pieces of one length form a bucket: each task fills its buckets as it cuts,
and hands a bucket over as a batch of equal shape once it holds ``BATCH_TOKENS``; at
its end it hands over what its buckets still hold. Documents are tokenized and cut
where they are read, without a shuffle, and a task holds no more than its buckets.

Defined cases: a null text is empty and gives one piece, the end id alone. A very
long text gives many pieces of the longest length. Repeated rows are packed one by
one, an empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import releasing
from linkloom.llm.encoding import CACHE_ENTRIES, encoder, forget

LONGEST = 1024
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int, batch_id long"
#: Tokens of a whole batch: so many by the bucket's length gives its sequences, a power of two as well.
BATCH_TOKENS = 1 << 16


def piece_lengths(n: int, longest: int = LONGEST) -> Iterator[int]:
    """The lengths, in order: ``longest`` as often as it goes, then the rest's binary digits from the highest."""
    for _ in range(n // longest):
        yield longest
    rest, bit = n % longest, longest
    while rest:
        bit //= 2
        if rest & bit:
            yield bit
            rest -= bit


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, longest: int = LONGEST, cache_entries: int = CACHE_ENTRIES, keep_encoder: bool = True) -> DataFrame:
    """One row per piece; ``longest`` is a power of two, ``tokenizer`` a path that every machine has.

    ``cache_entries`` bounds the pieces of text whose ids a worker keeps (300 bytes each);
    without ``keep_encoder`` it drops tokenizer and cache after each task.

    ``sequence_id`` is bucket, partition and a count within both, from the highest
    bits down: unique, and the same when a task is run again. Rows of one ``batch_id``
    follow each other and have one length; all but a task's last batch of a length are
    full. ``batch_id`` is the first sequence_id of the batch.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec, part = encoder(tokenizer, cache_entries), TaskContext.get().partitionId()
        end = np.asarray([end_id], "<u4").tobytes()
        lengths = [1 << k for k in range(longest.bit_length())]
        buckets: list[list[tuple]] = [[] for _ in lengths]
        done = [0] * len(lengths)
        whole = [max(1, BATCH_TOKENS // n) for n in lengths]

        def batch_of(k: int) -> pa.RecordBatch:
            """What bucket ``k`` holds, as one batch of equal shape; the bucket is empty then."""
            rows, buckets[k] = buckets[k], []
            n, first = len(rows), k << 58 | part << 36 | done[k]
            done[k] += n
            docs, starts, ids, sizes = zip(*rows)
            same = lambda x, t: pa.array(np.full(n, x), t)
            columns = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), same(lengths[k], pa.int64()), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64())]
            columns += [pa.array(np.arange(first, first + n)), same(0, pa.int64()), same(k, pa.int32()), same(first, pa.int64())]
            return pa.record_batch(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), codec.ids(texts), strict=True):
                ids += end
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, longest):
                    k = length.bit_length() - 1
                    buckets[k].append((doc, start, ids[4 * start : 4 * (start + length)], n))
                    start += length
                    if len(buckets[k]) == whole[k]:
                        yield batch_of(k)
        for k, rows in enumerate(buckets):
            if rows:
                yield batch_of(k)
        if not keep_encoder:
            del codec
            forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(cut), SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences as Parquet, a folder for each length; a file's rows keep the order of their batches."""
    pieces.write.partitionBy("bucket").parquet(path)


def batches(spark, path: str, length: int) -> DataFrame:
    """The batches of one length from written buckets: batch_id, n (its sequences), ids (theirs, one after another: a matrix of n rows)."""
    rows = spark.read.parquet(path).where(F.col("bucket") == length.bit_length() - 1)
    ordered = F.array_sort(F.collect_list(F.struct("sequence_id", "ids")))  # BATCH_TOKENS ids
    whole = rows.groupBy("batch_id").agg(ordered.alias("s"))
    return whole.select("batch_id", F.size("s").alias("n"), F.aggregate("s.ids", F.lit("").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "batch_id")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(pack(docs, public_tokenizers.path("byte_bpe_50k.json")))
