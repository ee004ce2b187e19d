"""N-gram Jaccard self-join by chosen paths (CPSJoin).

Documents with equal shingle sets are one class. In each run a class walks down a
random tree: at a node it follows every shingle whose hash at that node is below
1 / (threshold * size), so two classes of the threshold's similarity share one
child in the mean, and unlike ones hardly any. Classes that end at one leaf form a
bucket. A bucket is compared by brute force over 256-bit sketches against its
leaders, the members so far that resemble no earlier leader; buckets with too many
leaders are split further, by walking on from their leaf. A class that a leader has
stood for in its own lot of rows does not walk on with it, and is found by its other
leaves. Runs are repeated until
a pair at the threshold is missed with at most ``miss`` probability.

The links found this way only say what to compare. They are closed into groups, and
those are cut down before any text moves: within a group all sketches are compared
in blocks, and only classes whose sketches are as near as those of a pair at the
threshold stay together (``PAIR_BITS``; such a pair falls below with a probability
under 1e-6). Within what is left all pairs of classes are compared exactly, in
blocks of bounded size. Pairs are counted where they are found and never become
rows, so a group of n copies costs n rows.

Result: one row per document: doc_id, class_id (the least doc_id of all documents
that links connect) and n_links (other documents of at least that similarity,
equal ones included).

Defined cases: documents without words (null, empty, blank) link to nothing.
A text of fewer than five words is one shingle. Very long texts are compared by all
of their shingles. Repeated rows and equal texts are linked copies. Of equal doc_ids
the first row stands for its class. Rows with a null doc_id are compared too; they
never give a class its name unless all of its rows are null. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.beside import beside_texts, kept_rows, numbered
from linkloom.llm.common import releasing, written
from linkloom.llm.components import components
from linkloom.llm.shingles import mixed, set_key, shingle_set, text_bytes

THRESHOLD = 0.8
#: Probability to miss a pair of exactly that similarity.
MISS = 1e-4
#: Levels that a round walks down.
DEPTH = 3
#: Of 256 sketch bits: equal ones from which a member joins a leader, and from which it needs no leader of its own.
LINK_BITS, LEAD_BITS = 164, 200
#: Equal bits from which two classes of a group stay together. At similarity 0.8 a bit is equal with probability 0.848, 217 of 256 in the mean and
#: 5.7 about it; of the smallest sets, 4 and 5 shingles, with 0.8125, 208 in the mean and 6.2 about it.
PAIR_BITS = 176
#: A bucket with more leaders is split further.
LEADERS = 256
#: Classes of a block of sketches; classes and shingles of a block of an exact comparison.
SKETCH_BLOCK = 4096
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 2_000_000
#: Hashes of nodes and shingles that a walk computes at once, unless one node has more.
MATRIX = 131_072
#: Documents whose leaves a task holds at once, and combines before they travel.
LOT = 2_000
#: A class at a leaf with its sketch; or, with ``to``, a link that is settled already.
PATHS = "path long, key long, s0 long, s1 long, s2 long, s3 long, to long"


def runs_needed(threshold: float = THRESHOLD, miss: float = MISS, depth: int = DEPTH) -> int:
    """Walks of a pair at the threshold are a critical branching process; survival to ``depth`` by its recursion."""
    dead = 0.0
    for _ in range(depth):
        dead = math.exp(dead - 1)
    return math.ceil(math.log(miss) / math.log(dead))


def _walk(shingles, nodes, threshold: float, depth: int):
    """Leaves below ``nodes`` (uint64) for a set, over all runs at once."""
    import numpy as np

    share = min(1.0, 1 / (threshold * len(shingles)))
    limit = np.uint64(min(2**64 - 1, int(share * 2**64)))
    for _ in range(depth):
        if not len(nodes):
            break
        factors = mixed(nodes) | np.uint64(1)
        kept = []
        step = max(1, MATRIX // len(shingles))  # bounds the matrix for very large sets
        for lo in range(0, len(nodes), step):
            at, token = np.divmod(np.flatnonzero(mixed_rows(shingles, factors[lo : lo + step]) < limit), len(shingles))
            kept.append(mixed(nodes[lo + at] * np.uint64(0xD1342543DE82EF95) + shingles[token]))
        nodes = np.concatenate(kept)
    return nodes


def mixed_rows(shingles, factors):
    import numpy as np

    x = np.multiply.outer(factors, shingles)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    return x


def _sketch(shingles):
    """256 bits: the signs of sums over the shingles' random bits."""
    import numpy as np

    total = np.zeros(256, np.int64)
    for lo in range(0, len(shingles), 100_000):
        part = shingles[lo : lo + 100_000]
        words = np.stack([mixed(part + np.uint64(c * 0x632BE59BD9B4E019 & (2**64 - 1))) for c in (1, 2, 3, 4)], 1)
        bits = np.unpackbits(words.view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):  # sums of so many bits fit a byte
            total += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(shingles)).view(np.int64)


class _Bucket:
    """Leaders of one bucket, and which of them are known to hang together."""

    def __init__(self, most: int):
        import numpy as np

        self.most, self.keys, self.root = most, [], []
        self.bits = np.zeros((8, 4), np.uint64)

    def _top(self, j: int) -> int:
        while self.root[j] != j:
            j = self.root[j]
        return j

    def add(self, key: int, bits) -> tuple[list[int], bool]:
        """Classes to link ``key`` to, one for each part of the bucket that it resembles; whether a leader stands for it."""
        import numpy as np

        n = len(self.keys)
        alike = 256 - np.bitwise_count(self.bits[:n] ^ bits).sum(1, dtype=np.int64) if n else np.zeros(0, np.int64)
        parts = {}
        for j in np.flatnonzero(alike >= LINK_BITS).tolist():
            parts.setdefault(self._top(j), j)
        links = [self.keys[j] for j in parts.values()]
        tops = sorted(parts)
        for t in tops[1:]:
            self.root[t] = tops[0]
        led = bool(n) and int(alike.max()) >= LEAD_BITS
        if not led and n <= self.most:
            if n == len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
            self.bits[n] = bits
            self.keys.append(key)
            self.root.append(tops[0] if tops else n)
        return links, led


def memberships(texts: DataFrame) -> DataFrame:
    """rid, doc_id, key (the class; null without words), n (its shingles)."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for t in batch.column(2):
                s = shingle_set(text_bytes(t))
                keys.append(set_key(s) if len(s) else None)
                sizes.append(len(s))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], names=["rid", "doc_id", "key", "n"])

    return texts.mapInArrow(releasing(name), "rid long, doc_id long, key long, n long")


def _combined(paths, keys, bits, leaders: int) -> pa.RecordBatch:
    """Rows of one batch for the exchange: at each leaf only leaders travel, the others are linked to them here."""
    import numpy as np

    order = np.argsort(paths, kind="stable")
    ordered = paths[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(paths) else np.zeros(0, np.int64)
    ends = np.append(begins[1:], len(paths))
    travels, links = np.ones(len(paths), bool), set()
    for g in np.flatnonzero(ends - begins > 1):
        own = order[begins[g] : ends[g]]
        bucket = _Bucket(leaders)
        for k in own.tolist():
            found, led = bucket.add(int(keys[k]), bits[k].view(np.uint64))
            links.update((int(keys[k]), to) for to in found)
            travels[k] = not led
    m = len(links)
    a, b = (np.fromiter((x[i] for x in links), np.int64, m) for i in (0, 1))
    sent = bits[travels]
    columns = [pa.array(np.concatenate([paths[travels], a ^ b])), pa.array(np.concatenate([keys[travels], a]))]
    columns += [pa.array(np.concatenate([sent[:, c], np.zeros(m, np.int64)])) for c in range(4)]
    to = np.concatenate([np.zeros(int(travels.sum()), np.int64), b])
    columns.append(pa.array(to, mask=np.arange(len(to)) < int(travels.sum())))
    return pa.record_batch(columns, names=[c.split()[0] for c in PATHS.split(", ")])


def _leaves(rows, threshold: float, leaders: int) -> Iterator[pa.RecordBatch]:
    """From (key, shingles, nodes) of one batch, the rows of PATHS below the nodes."""
    import numpy as np

    paths, keys, sketches = [], [], []
    for key, s, nodes in rows:
        leaves = np.unique(_walk(s, nodes, threshold, DEPTH))
        paths.append(leaves.view(np.int64))
        keys.append(np.full(len(leaves), key, np.int64))
        sketches.append(np.broadcast_to(_sketch(s), (len(leaves), 4)))
    if paths:
        yield _combined(np.concatenate(paths), np.concatenate(keys), np.concatenate(sketches), leaders)


def _paths(texts: DataFrame, threshold: float, miss: float, leaders: int) -> DataFrame:
    """The leaves of each class, once for each lot of rows it occurs in."""
    runs = runs_needed(threshold, miss)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        roots = mixed(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

        def classes(column, seen):
            for t in column:
                s = shingle_set(text_bytes(t))
                if len(s) and (key := set_key(s)) not in seen:
                    seen.add(key)
                    yield key, s, roots

        for batch in batches:
            for at in range(0, batch.num_rows, LOT):
                yield from _leaves(classes(batch.column(2).slice(at, LOT), set()), threshold, leaders)

    return texts.mapInArrow(releasing(walk), PATHS)


def _walk_on(split: DataFrame, members: DataFrame, texts: DataFrame, threshold: float, leaders: int) -> DataFrame:
    """Leaves further down for the classes of buckets that were too diverse."""
    nodes = split.groupBy("key").agg(F.collect_list("path").alias("nodes"))  # a few dozen paths a class
    first = members.where("key is not null").groupBy("key").agg(F.min("rid").alias("rid"))
    rows = beside_texts(texts, nodes.join(first, "key"), ["key", "nodes"], "split")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
            yield from _leaves(((k, shingle_set(text_bytes(t)), np.asarray(n, np.int64).view(np.uint64)) for k, n, t in rows), threshold, leaders)

    return rows.mapInArrow(releasing(walk), PATHS)


def _bucket_links(paths: DataFrame, leaders: int = LEADERS) -> DataFrame:
    """Rows (a, b, split): a link of two classes, or with split true the class a in the too diverse bucket b."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        path, last, bucket, members = None, None, None, []
        for batch in batches:
            names, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bits = np.stack([batch.column(k).to_numpy() for k in range(2, 6)], 1).view(np.uint64)
            settled = batch.column(6).is_valid().to_numpy(zero_copy_only=False)
            a, b, s = keys[settled].tolist(), batch.column(6).drop_null().to_pylist(), [False] * int(settled.sum())
            # what is alone in its bucket, and the bucket whole within this batch, needs nothing
            same = np.concatenate([[path == names[0]], names[1:] == names[:-1]]) if len(names) else np.zeros(0, bool)
            busy = same.copy()
            busy[:-1] |= same[1:]
            if len(busy):
                busy[-1] = True
            for k in np.flatnonzero(busy & ~settled):
                if names[k] != path:
                    path, last, bucket, members = names[k], None, _Bucket(leaders), []
                key = int(keys[k])
                if key == last:
                    continue  # the class came from several batches
                last = key
                over = len(bucket.keys) > leaders
                found, _ = bucket.add(key, bits[k])
                a += [key] * len(found)
                b += found
                s += [False] * len(found)
                if not over:
                    members.append(key)
                    over = len(bucket.keys) > leaders  # one too many: all members so far walk on
                else:
                    members = [key]
                if over:
                    a += members
                    b += [int(path)] * len(members)
                    s += [True] * len(members)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.bool_())], names=["a", "b", "split"])

    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.repartition(n, "path").sortWithinPartitions("path", "key").mapInArrow(releasing(scan), "a long, b long, split boolean")


def candidate_groups(texts: DataFrame, members: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, leaders: int = LEADERS) -> DataFrame:
    """(node, root): classes that links of buckets connect."""
    links, paths = None, _paths(texts, threshold, miss, leaders)
    for _ in range(8):
        found = written(_bucket_links(paths, leaders).distinct(), "links")
        part = found.where("not split").select("a", "b")
        links = part if links is None else links.unionByName(part)
        split = found.where("split").select(F.col("a").alias("key"), F.col("b").alias("path"))
        if split.isEmpty():
            return components(links)
        paths = _walk_on(split, members, texts, threshold, leaders)
    # what 27 levels could not tell apart is alike: link it to the least of its bucket
    rest = split.groupBy("path").agg(F.min("key").alias("b"))
    return components(links.unionByName(split.join(rest, "path").select(F.col("key").alias("a"), "b")))


def _spread(rows: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Rows once for each pair of blocks of their group that their own block (``own``) is in: columns i <= j."""
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return pairs.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def _in_blocks(rows: DataFrame, blocks: F.Column) -> DataFrame:
    """Rows of (root, key, ...) with the number of blocks of their group, and their own block by a hash of the key."""
    sizes = rows.groupBy("root").agg(F.count("*").alias("g"), F.sum("n").alias("total")).select("root", F.greatest(F.ceil(blocks).cast("int"), F.lit(1)).alias("blocks"))
    return rows.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "key"), F.col("blocks")).cast("int"))


def _near_groups(texts: DataFrame, grouped: DataFrame, pair_bits: int = PAIR_BITS) -> DataFrame:
    """(key, root): the groups cut down to classes that near sketches connect; classes that are alone are left out."""
    with_text = beside_texts(texts, grouped, ["root", "key", "n"], "sketched")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            bits = [_sketch(shingle_set(text_bytes(t))) for t in batch.column(3)]
            bits = np.stack(bits) if bits else np.zeros((0, 4), np.int64)
            yield pa.record_batch([*batch.columns[:3], *[pa.array(bits[:, c]) for c in range(4)]], names=["root", "key", "n", "s0", "s1", "s2", "s3"])

    sketches = written(with_text.mapInArrow(releasing(sketch), "root long, key long, n long, s0 long, s1 long, s2 long, s3 long"), "sketches")
    spread = _spread(_in_blocks(sketches, F.col("g") / SKETCH_BLOCK)).drop("n", "blocks")

    def near(table: pa.Table) -> pa.Table:
        import numpy as np

        keys = table["key"].to_numpy()
        bits = np.stack([table[f"s{c}"].to_numpy() for c in range(4)], 1).view(np.uint64)
        root = np.arange(len(keys))

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x in range(1, len(keys)):
            # those of one part need no more than one link
            alike = np.flatnonzero(256 - np.bitwise_count(bits[:x] ^ bits[x]).sum(1, dtype=np.int64) >= pair_bits)
            for y in np.unique(root[alike]).tolist():
                a, b = top(x), top(y)
                root[max(a, b)] = min(a, b)
        heads = np.asarray([top(x) for x in range(len(keys))], np.int64)
        own = heads != np.arange(len(keys))
        return pa.table({"a": keys[own], "b": keys[heads[own]]})

    return components(spread.groupBy("root", "i", "j").applyInArrow(near, "a long, b long")).withColumnRenamed("node", "key")


def _compare(texts: DataFrame, members: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(key, links, parent, whole): for each class and block, weighted links found there and one class it is linked to."""
    classes = members.where("key is not null").groupBy("key").agg(
        F.min("rid").alias("rid"), F.count("*").alias("copies"), F.max("n").alias("n")
    )
    grouped = classes.join(groups.withColumnRenamed("node", "key"), "key")
    near = _near_groups(texts, grouped.select("rid", "root", "key", "n"))
    placed = _in_blocks(classes.join(near, "key"), F.greatest(F.col("g") / BLOCK_CLASSES, F.col("total") / BLOCK_SHINGLES))
    with_text = beside_texts(texts, placed, ["root", "blocks", "own", "key", "copies"], "placed")
    spread = _spread(with_text)

    def compare(table: pa.Table) -> pa.Table:
        import numpy as np

        keys, own, copies = (table[c].to_numpy() for c in ("key", "own", "copies"))
        cross = table["i"][0].as_py() != table["j"][0].as_py()
        whole = table["blocks"][0].as_py() == 1
        members = [shingle_set(text_bytes(t)) for t in table["text"]]
        sizes = np.asarray([len(s) for s in members], np.int64)
        parent, links = keys.copy(), np.zeros(len(keys), np.int64)
        root = list(range(len(keys)))

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        if len(keys) > 1:
            flat, owner = np.concatenate(members), np.repeat(np.arange(len(keys)), sizes)
            by = np.argsort(flat, kind="stable")
            flat, owner = flat[by], owner[by]
            begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            ends = np.append(begins[1:], len(flat))
            starts = flat[begins]
            for x, s in enumerate(members):
                at = np.searchsorted(starts, s)
                lo, n = begins[at], ends[at] - begins[at]
                total = int(n.sum())
                # all owners of the set's shingles, list by list
                idx = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
                both = np.bincount(owner[idx], minlength=len(keys))
                alike = both >= threshold * (sizes + sizes[x] - both) - 1e-9
                alike[x] = False
                if cross:
                    alike &= own != own[x]
                links[x] = copies[alike].sum()
                for y in np.flatnonzero(alike[:x]):
                    a, b = top(x), top(int(y))
                    root[max(a, b)] = min(a, b)
            parent = keys[[top(x) for x in range(len(keys))]]
        return pa.table({"key": keys, "links": links, "parent": parent, "whole": np.full(len(keys), bool(whole))})

    slim = spread.select("root", "blocks", "own", "key", "copies", "text", "i", "j")
    return slim.groupBy("root", "i", "j").applyInArrow(compare, "key long, links long, parent long, whole boolean")


def _classes(texts: DataFrame, threshold: float, miss: float) -> DataFrame:
    """One row per row: rid, doc_id, class_rid (the first row of its class), class_id, n_links."""
    members = written(memberships(texts), "members")
    groups = candidate_groups(texts, members, threshold, miss)
    compared = written(_compare(texts, members, groups, threshold), "compared")
    links = compared.groupBy("key").agg(F.sum("links").alias("links"), F.min("parent").alias("parent"))
    apart = compared.where("not whole and parent <> key").select(F.col("key").alias("a"), F.col("parent").alias("b"))
    if not apart.isEmpty():
        joined = components(apart).select(F.col("node").alias("key"), "root")
        links = links.join(joined, "key", "left").select("key", "links", F.coalesce("root", "parent").alias("parent"))
    # the first row: least doc_id, nulls last, then place
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    classes = members.where("key is not null").groupBy("key").agg(first.alias("first"), F.count("*").alias("copies"))
    named = classes.join(links, "key", "left").withColumn("parent", F.coalesce("parent", "key"))
    least = named.groupBy("parent").agg(F.min("first").alias("head"))
    named = named.join(least, "parent").select("key", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = members.where("key is not null").join(named, "key")
    out = out.select("rid", "doc_id", F.col("head.rid").alias("class_rid"), F.col("head.doc_id").alias("class_id"), "n_links")
    blank = members.where("key is null")
    return out.unionByName(blank.select("rid", "doc_id", F.col("rid").alias("class_rid"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """One row per document: doc_id, class_id, n_links."""
    return _classes(numbered(docs)[1], threshold, miss).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """The document with the least doc_id of each class, with its own columns."""
    docs, texts = numbered(docs)
    return kept_rows(docs, _classes(texts, threshold, miss).where("rid = class_rid"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
