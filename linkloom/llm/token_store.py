"""Token ids as raw files, with a minimal perfect hash index from document keys to offsets.

A shard is two files: ``.ids``, the ids of its documents one after another, as
unsigned 16- or 32-bit little-endian integers, and ``.mph``, its index. The index
has n slots for n distinct keys: a key's bucket gives the displacement that sends
it to its own slot (buckets of one key name the slot itself), and the slot holds a
32-bit fingerprint of the key and the row of its first document. A lookup seeks
the bucket, the slot, the row's offsets and the ids, whatever the shard's size; a
whole read resolves all keys of a shard by their slots and fails on a slot whose
fingerprint or row is not its key's.

Documents are dealt by range of doc_id, so shards follow each other in ascending
order; a small manifest holds each shard's range and the number of ids before it.
Files are written under a name of the attempt and named only by the manifest, so
a task that is run again or twice leaves no doubt about what belongs to the store.

Defined cases: a null text is empty, so its document is the end id alone. Rows
with equal doc_id stand together, ordered by a hash of their text, and may fill
several shards and tasks; a lookup returns all of them. Rows with a null doc_id come
first and have no key. Shards end after ``shard_bytes`` of ids or ``shard_docs``
documents, whichever comes first, so neither long texts nor very many short ones need
more memory than that, besides one document's ids. An empty table gives a store
without shards; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import releasing, scratch_path
from linkloom.llm.encoding import encoder

END_ID = 2
SHARD_BYTES = 32_000_000
#: Documents of a shard: its index is built, and its offsets are held, at once.
SHARD_DOCS = 100_000
MAGIC = b"LLTS"
#: magic, version, bytes of an id, seed, documents, keys, buckets, documents without a key
HEADER = struct.Struct("<4sHHQQQQQ")
KEYS_PER_BUCKET = 4
MANIFEST = "part int, no int, file string, width int, first_doc long, last_doc long, n_docs long, n_tokens long"


def _mixed(keys, seed: int):
    """A 64-bit mix of each key."""
    import numpy as np

    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _hashes(keys, seed: int, buckets: int):
    """Of each key: its bucket, the hash that displacements are mixed into, its fingerprint."""
    import numpy as np

    a, b = _mixed(keys, seed), _mixed(keys, seed + 1)
    return (a % np.uint64(buckets)).astype(np.int64), b, (a >> np.uint64(32)).astype(np.uint32)


def _slot(base, shift, n: int):
    """The slots of hashes under displacements: each displacement draws them anew."""
    import numpy as np

    return (_mixed(base + np.asarray(shift).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0) % np.uint64(n)).astype(np.int64)


#: Displacements tried for a bucket before another seed is taken.
TRIES = 1 << 20


def build_index(keys) -> tuple[int, object, object, object]:
    """(seed, displacements, slot of each key, fingerprint of each key) of distinct int64 keys."""
    import numpy as np

    n = len(keys)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    for seed in range(1, 100):
        bucket, base, mark = _hashes(keys, seed, buckets)
        shift, slots = np.zeros(buckets, np.int64), np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        ends = np.cumsum(sizes)
        spare, done = 0, True
        for b in np.argsort(-sizes, kind="stable"):  # the largest first, while there is most room
            if sizes[b] == 0:
                break
            own = order[ends[b] - sizes[b] : ends[b]]
            if sizes[b] == 1:
                while not free[spare]:
                    spare += 1
                shift[b], slots[own] = -spare - 1, spare
                free[spare] = False
                continue
            found = None
            for low in range(0, TRIES, 128):
                tried = _slot(base[own], np.arange(low, low + 128)[:, None], n)
                found = next((d for d in np.flatnonzero(free[tried].all(1)) if len(set(tried[d].tolist())) == len(own)), None)
                if found is not None:
                    break
            if found is None:
                done = False
                break
            shift[b], slots[own] = low + found, tried[found]
            free[slots[own]] = False
        if done:
            return seed, shift, slots, mark
    raise ValueError("no index was found; are the keys distinct?")


def _filesystem(uri: str):
    """Of a whole URI, as ``scratch_path`` gives it; tasks open files through pyarrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_index(doc_ids: list, starts: list[int], width: int) -> bytes:
    """The bytes of an ``.mph`` file; starts has one entry more than there are documents."""
    import numpy as np

    unkeyed = sum(d is None for d in doc_ids)  # nulls come first
    docs = np.asarray([0 if d is None else d for d in doc_ids], np.int64)
    keys, rows = np.unique(docs[unkeyed:], return_index=True)
    seed, shift, slots, mark = build_index(keys) if len(keys) else (1, np.zeros(0, np.int64), None, None)
    marks, at = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint64)
    if len(keys):
        marks[slots], at[slots] = mark, rows + unkeyed
    head = HEADER.pack(MAGIC, 1, width, seed, len(docs), len(keys), len(shift), unkeyed)
    return head + shift.astype("<i8").tobytes() + marks.astype("<u4").tobytes() + at.astype("<u8").tobytes() + np.asarray(starts, "<u8").tobytes() + docs.astype("<i8").tobytes()


class ShardIndex:
    """An ``.mph`` file in memory."""

    def __init__(self, data: bytes):
        import numpy as np

        magic, version, self.width, self.seed, docs, keys, buckets, self.unkeyed = HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not an index file of this format")
        at = HEADER.size
        parts = []
        for kind, n in (("<i8", buckets), ("<u4", keys), ("<u8", keys), ("<u8", docs + 1), ("<i8", docs)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        self.shift, self.marks, self.rows, self.starts, self.docs = parts

    def resolve(self, keys):
        """The row of each distinct key's first document, by displacement, slot and fingerprint; -1 where the shard has no such key."""
        import numpy as np

        n = len(self.marks)
        if not n:
            return np.full(len(keys), -1, np.int64)
        bucket, base, mark = _hashes(keys, self.seed, len(self.shift))
        shift = self.shift[bucket]
        slot = np.where(shift < 0, -shift - 1, _slot(base, np.maximum(shift, 0), n))
        rows = self.rows[slot].astype(np.int64)
        found = (self.marks[slot] == mark) & (self.docs[rows] == keys)  # the key also refuses another one of equal fingerprint
        return np.where(found, rows, -1)


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encodes all documents into shards under ``out`` and returns the manifest, read from its file."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one doc_id may be many, so their texts' hashes take part in the ranges
    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    dealt = dealt.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        context = TaskContext.get()
        codec, part, attempt = encoder(tokenizer), context.partitionId(), uuid.uuid4().hex[:12]
        small = codec.tokenizer.get_vocab_size(with_added_tokens=True) <= 65_536 and end_id < 65_536
        kind, end = ("<u2" if small else "<u4"), np.asarray([end_id], "<u4").tobytes()
        width = np.dtype(kind).itemsize
        files, root = _filesystem(out)
        files.create_dir(f"{root}/shards", recursive=True)
        done, sink, name, ids_of, starts = [], None, None, [], [0]

        def close() -> None:
            sink.close()
            with files.open_output_stream(f"{root}/shards/{name}.mph") as f:
                f.write(_write_index(ids_of, starts, width))
            keyed = [d for d in ids_of if d is not None]
            done.append((part, len(done), name, width, keyed[0] if keyed else None, keyed[-1] if keyed else None, len(ids_of), starts[-1]))

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), codec.ids(t.as_py() for t in batch.column(1)), strict=True):
                if sink is not None and (starts[-1] * width >= shard_bytes or len(ids_of) >= shard_docs):
                    close()
                    sink, ids_of, starts = None, [], [0]
                if sink is None:
                    name = f"{part:06d}-{len(done):05d}-{attempt}"
                    sink = files.open_output_stream(f"{root}/shards/{name}.ids")
                ids = np.frombuffer(ids + end, "<u4").astype(kind)
                sink.write(ids.tobytes())
                ids_of.append(doc)
                starts.append(starts[-1] + len(ids))
        if sink is not None:
            close()
        types = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        columns = zip(*done) if done else [[] for _ in names]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    dealt.mapInArrow(releasing(store), MANIFEST).write.parquet(f"{out}/manifest")
    return manifest(spark, out)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """A row per shard, with ``base``, the ids of all documents before it."""
    before = Window.orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)  # rows of shards, not of documents
    shards = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(spark: SparkSession, out: str) -> DataFrame:
    """All documents from the files: doc_id, start, n_tokens, ids (unsigned 32-bit little-endian).

    Keys are looked up in their shard's index; what it answers says where ids lie.
    """
    shards = manifest(spark, out).select("file", "width", "base")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        files, root = _filesystem(out)
        for batch in batches:
            for file, width, base in zip(*(c.to_pylist() for c in batch.columns)):
                with files.open_input_stream(f"{root}/shards/{file}.mph") as f:
                    index = ShardIndex(f.read())
                keys, times = np.unique(index.docs[index.unkeyed :], return_counts=True)
                first = index.resolve(keys)
                if (first < 0).any():
                    raise ValueError(f"the index of shard {file} does not lead to {int((first < 0).sum())} of its keys")
                # rows without a key, then each key's rows from where its slot says
                rows = np.concatenate([np.arange(index.unkeyed), np.repeat(first - np.cumsum(times) + times, times) + np.arange(int(times.sum()))])
                owner = np.concatenate([np.zeros(index.unkeyed, np.int64), np.repeat(keys, times)])
                lo, hi = (index.starts[rows + k].astype(np.int64) for k in (0, 1))
                if len(rows) and ((lo[1:] != hi[:-1]).any() or lo[0] or hi[-1] != index.starts[-1]):
                    raise ValueError(f"the rows that the index of shard {file} names do not follow each other")
                with files.open_input_stream(f"{root}/shards/{file}.ids") as f:
                    row = 0
                    while row < len(rows):
                        # as many documents as fit some MB, one at least
                        last = max(row + 1, int(np.searchsorted(lo, lo[row] + 2_000_000, "right")))
                        last = min(last, len(rows))
                        ids = np.frombuffer(f.read(int(hi[last - 1] - lo[row]) * width), f"<u{width}").astype("<u4")
                        values = pa.py_buffer(ids.tobytes())
                        docs = pa.array(owner[row:last], mask=np.arange(row, last) < index.unkeyed)
                        ends = np.append(lo[row:last], hi[last - 1]) - lo[row]
                        yield pa.record_batch(
                            [docs, pa.array(lo[row:last] + base), pa.array(hi[row:last] - lo[row:last]), pa.Array.from_buffers(pa.large_binary(), last - row, [None, pa.py_buffer((ends * 4).tobytes()), values]).cast(pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        row = last

    return shards.repartition(n).mapInArrow(releasing(load), "doc_id long, start long, n_tokens long, ids binary")


class TokenStore:
    """Keyed access from the driver or any process that sees the folder.

    A lookup seeks in the shard's files and reads some hundred bytes of its index and
    the ids; of each shard only the header may be kept, of the last ``HEADERS`` ones.
    """

    HEADERS = 4096

    def __init__(self, spark: SparkSession, out: str):
        import bisect
        from collections import OrderedDict

        self.files, self.root = _filesystem(out)
        keyed = manifest(spark, out).where("first_doc is not null").orderBy("part", "no")
        self.shards = [r.asDict() for r in keyed.toLocalIterator()]  # a row for each shard_bytes of ids or shard_docs documents
        self._lasts = [s["last_doc"] for s in self.shards]
        self._bisect = bisect.bisect_left
        self._headers: OrderedDict[str, tuple] = OrderedDict()

    def _header(self, file: str, source) -> tuple:
        if file not in self._headers:
            self._headers[file] = HEADER.unpack(source.read_at(HEADER.size, 0))
            while len(self._headers) > self.HEADERS:
                self._headers.popitem(last=False)
        return self._headers[file]

    def _spans(self, file: str, doc_id: int) -> Iterator[tuple[int, int, int]]:
        """(first id, end, bytes of an id) of each row with the key, read by seeking bucket, slot and offsets."""
        import numpy as np

        with self.files.open_input_file(f"{self.root}/shards/{file}.mph") as source:
            magic, version, width, seed, docs, keys, buckets, _ = self._header(file, source)
            if magic != MAGIC or version != 1:
                raise ValueError("not an index file of this format")
            if not keys:
                return
            one = lambda kind, at, k: int(np.frombuffer(source.read_at(np.dtype(kind).itemsize, at + k * np.dtype(kind).itemsize), kind)[0])
            shifts = HEADER.size
            marks = shifts + 8 * buckets
            rows = marks + 4 * keys
            starts = rows + 8 * keys
            owners = starts + 8 * (docs + 1)
            bucket, base, mark = _hashes(np.asarray([doc_id], np.int64), seed, buckets)
            shift = one("<i8", shifts, int(bucket[0]))
            slot = -shift - 1 if shift < 0 else int(_slot(base, shift, keys)[0])
            if one("<u4", marks, slot) != int(mark[0]):
                return
            row = one("<u8", rows, slot)
            while row < docs and one("<i8", owners, row) == doc_id:  # also refuses another key of equal fingerprint
                yield one("<u8", starts, row), one("<u8", starts, row + 1), width
                row += 1

    def get(self, doc_id: int) -> list[list[int]]:
        """The ids of every row with this key."""
        import numpy as np

        out, k = [], self._bisect(self._lasts, doc_id)
        while k < len(self.shards) and self.shards[k]["first_doc"] <= doc_id:
            file = self.shards[k]["file"]
            for lo, hi, width in self._spans(file, doc_id):
                with self.files.open_input_file(f"{self.root}/shards/{file}.ids") as f:
                    out.append(np.frombuffer(f.read_at((hi - lo) * width, lo * width), f"<u{width}").tolist())
            k += 1
        return out


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scratch_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
