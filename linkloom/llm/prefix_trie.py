"""Trie of conversation prefixes, built as a Patricia tree over sorted conversations.

A conversation becomes an array of prefix digests, one of 16 bytes for each turn;
two conversations share a node if they share that digest. Equal conversations become
one row, their ids hashed as a sorted stream. The distinct rows are sorted by their
arrays, so that all that share a prefix are neighbours, and what two neighbours have
in common is a point where the tree branches or a conversation ends: with the ends
themselves these are all its points. Rows meet only those of their prefixes that a
neighbour shares, and of these only the points, so that long unshared tails stay
one edge each and cost nothing.

Aggregates belong to points: members and leaves are sums over the rows below, children
are counted by parent, and saved tokens are suffix sums of edge weights along the row
that names a point, then sums by point. At last each edge is expanded into its unary
nodes, whose saved tokens are the point's less a prefix of the edge's words (a suffix
sum of the edge plus what hangs below it).

No step depends on the order of tasks. Prefixes that many share are summed before they
are shuffled; a conversation is one row of 24 bytes a turn, without its texts. Copies
of one conversation, however many, pass one task as a stream of ids, for their digest
is one hash of all of them in order.

Defined cases: rows with a null conv_id belong to no conversation and are left out. A
null turn stands first; turns of equal number are in order of role, then of the digest
of role and text, and rows that are repeated are turns of their own. Null roles and
texts are empty. Remainders of negative ids have their sign. Texts are read whole,
whatever their length. A conversation without rebuilt turns ends at the root. Without
conversations there is no node, not even a root. Columns other than conv_id, turn, role
and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import release, releasing, written

#: Conversations of one family share turns of the one whose id is divisible by this, and at most so many less one of them.
FAMILY, SHARED = 20, 4
ROOT = bytes(16)
EMPTY = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): of each conversation the digests and word counts of its turns, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the length of the role tells where it ends
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role), role, text).cast("binary"), 256), 1, 32))
    words = F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("d"), words.alias("w")).alias("t")
    )
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation with its first turns replaced by those of the first of its family."""
    own = _turns(conversations)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    first = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, SHARED - 1).alias("shared"))
    own = own.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    joined = own.join(first, "first", "left")
    rest = F.slice(F.col("turns"), F.col("h") + 1, F.size("turns"))
    shared = F.when(F.col("h") > 0, F.slice(F.col("shared"), F.lit(1), F.greatest("h", F.lit(1))))
    return joined.select("conv_id", F.when(shared.isNull(), rest).otherwise(F.concat(shared, rest)).alias("turns"))


def _prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the turns to digests of the prefixes, words to running sums."""
    for batch in batches:
        prefixes, sums = [], []
        for turns in batch.column(1).to_pylist():
            at, total, p, s = ROOT, 0, [], []
            for t in turns:
                at = hashlib.sha256(at + t["d"]).digest()[:16]
                total += t["w"]
                p.append(at)
                s.append(total)
            prefixes.append(p)
            sums.append(s)
        last = [p[-1] if p else ROOT for p in prefixes]
        columns = [batch.column(0), pa.array(last, pa.binary()), pa.array(prefixes, pa.list_(pa.binary())), pa.array(sums, pa.list_(pa.int64()))]
        yield pa.record_batch(columns, names=["conv_id", "last", "p", "s"])


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, last, p, s): digests of all prefixes, the last of them, and running sums of words."""
    return turns.mapInArrow(releasing(_prefixed), "conv_id long, last binary, p array<binary>, s array<long>")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (last, conv_id) to one row for each ``last``: the least id, how many, and the hash of all."""
    now, out = None, []
    names = ["last", "conv_id", "m", "ends"]
    row = lambda: (now, least, n, digest.hexdigest())
    pack = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=names)
    least, n, digest = None, 0, None
    for batch in batches:
        for last, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if last != now:
                if now is not None:
                    out.append(row())
                now, least, n, digest = last, conv, 0, hashlib.sha256()
            digest.update(f",{conv}".encode() if n else str(conv).encode())
            n += 1
        if len(out) >= 1000:
            yield pack(out)
            out = []
    if now is not None:
        out.append(row())
    if out:
        yield pack(out)


def classes(sequences: DataFrame) -> DataFrame:
    """(last, conv_id, m, ends): equal conversations as one, named by their least id; ``ends`` is the digest of their ids."""
    n = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = sequences.select("last", "conv_id").repartition(n, "last").sortWithinPartitions("last", "conv_id")
    return ids.mapInArrow(releasing(_ends), "last binary, conv_id long, m long, ends string")


def _common(other: Column) -> Column:
    """How many first elements ``p`` has in common with another array; 0 where there is none."""
    differs = F.array_position(F.zip_with("p", other, lambda a, b: a.eqNullSafe(b)), F.lit(False))
    return F.when(other.isNull(), 0).when(differs == 0, F.size("p")).otherwise(differs - 1).cast("int")


def neighbours(distinct: DataFrame) -> DataFrame:
    """``distinct`` with ``before`` and ``behind``: how many turns a row shares with its neighbours in sorted order.

    Rows are dealt by range and written with the number of their range; the row that
    stands before a range, or behind it, comes from the few rows at the ranges' borders.
    """
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = distinct.repartitionByRange(n, "p").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "sorted")
    borders = ranged.groupBy("part").agg(F.min("p").alias("least"), F.max("p").alias("most"))
    parts = Window.orderBy("part")  # a row per range
    borders = borders.select("part", F.lag("most").over(parts).alias("most"), F.lead("least").over(parts).alias("least"))
    own = Window.partitionBy("part").orderBy("p")
    rows = ranged.withColumn("a", F.lag("p").over(own)).withColumn("b", F.lead("p").over(own))
    rows = rows.join(F.broadcast(borders), "part")
    shared = lambda near, far: _common(F.coalesce(F.col(near), F.col(far)))
    return rows.select(*distinct.columns, shared("a", "most").alias("before"), shared("b", "least").alias("behind"))


def points(rows: DataFrame) -> DataFrame:
    """(row, at, depth, ...): each row's points, a line each, with the depth of the point before it.

    ``rows`` has conv_id, m, p, s, before, behind. ``sum`` are the row's words up to it, ``leaf`` tells whether nobody
    goes on where the row ends, ``ends`` whether that is here.
    """
    size = F.size("p")
    leaf = (F.col("behind") < size).alias("leaf")  # what goes on stands right behind
    ends = rows.where("size(p) > 0").select("conv_id", "m", F.col("last").alias("at"), size.alias("depth"), F.get("s", size - 1).alias("sum"), leaf, F.lit(True).alias("ends"))
    forks = rows.where("behind > 0").select(F.get("p", F.col("behind") - 1).alias("at")).unionByName(ends.select("at")).distinct()
    shared = F.greatest(F.least(F.greatest("before", "behind"), size - 1), F.lit(0))
    met = rows.select("conv_id", "m", F.slice("p", F.lit(1), shared).alias("p"), "s", leaf)
    met = met.select("conv_id", "m", F.posexplode("p").alias("k", "at"), "s", "leaf")
    met = met.select("conv_id", "m", "at", (F.col("k") + 1).alias("depth"), F.get("s", F.col("k")).alias("sum"), "leaf")
    met = met.join(forks, "at", "left_semi").select("conv_id", "m", "at", "depth", "sum", "leaf", F.lit(False).alias("ends"))
    return met.unionByName(ends)


def _edges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' points with the edge into each, and the compressed tree: a row per point with its aggregates."""
    along = Window.partitionBy("row").orderBy("depth")
    met = points(rows).withColumnRenamed("conv_id", "row")
    met = met.select("*", F.lag("at").over(along).alias("parent"), F.coalesce(F.lag("depth").over(along), F.lit(0)).alias("top"), (F.col("sum") - F.coalesce(F.lag("sum").over(along), F.lit(0))).alias("words"))
    met = written(met, "points")
    tree = met.groupBy("at").agg(
        F.min("row").alias("conv_id"), F.sum("m").alias("n"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        *[F.first(c).alias(c) for c in ("depth", "parent", "top", "words")], F.max(F.when(F.col("ends"), F.col("row"))).alias("ending"),
    )
    return met, tree


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    all_ = written(sequences(rebuilt(conversations)), "sequences")
    same = written(classes(all_), "classes")
    rows = all_.select("conv_id", "last", "p", "s").join(same.select("conv_id", "m"), "conv_id")
    rows = written(neighbours(rows), "rows")
    release(all_)
    met, tree = _edges(rows)
    tree = written(tree, "tree")
    # an edge weighs its words times the members that have them again; each point is on the row that names it once
    weight = tree.select(F.col("conv_id").alias("row"), "at", ((F.col("n") - 1) * F.col("words")).alias("weight"))
    below = Window.partitionBy("row").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = met.join(weight, ["row", "at"], "left").select("at", F.sum(F.coalesce("weight", F.lit(0))).over(below).alias("saved"))
    saved = sums.groupBy("at").agg(F.sum("saved").alias("saved"))
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("at")).agg(F.count("*").alias("n_children"))
    tree = tree.join(saved, "at").join(children, "at", "left").na.fill(0, ["n_children"])
    above = tree.select(F.col("at").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tree = tree.join(above, "parent", "left").join(same.select("conv_id", "ends").withColumnRenamed("conv_id", "ending"), "ending", "left")
    least = same.agg(F.min("conv_id").alias("least"))
    top = tree.where("parent is null").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
    counted = same.agg(F.min("conv_id").alias("conv_id"), F.sum("m").alias("n_convs"), F.max(F.when(F.col("last") == F.lit(ROOT), F.col("ends"))).alias("ends")).where("conv_id is not null")
    root = counted.crossJoin(top).select(  # one row and one row
        "conv_id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"),
        F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
    return _expanded(tree.crossJoin(F.broadcast(least)), rows).unionByName(root).select(*[F.col(c).cast("long").alias(c) if c != "ends_sha256" else F.col(c) for c in root.columns])


def _expanded(tree: DataFrame, rows: DataFrame) -> DataFrame:
    """Each point and the unary nodes of the edge that leads to it; ``least`` names the root."""
    edge = tree.join(rows.select("conv_id", "s"), "conv_id").select("*", F.explode(F.sequence(F.col("top") + 1, "depth")).alias("d"))
    # words of the edge above node d: d - 1 turns of the row less those up to the edge's top
    upto = lambda k: F.when(k > 0, F.element_at("s", F.greatest(k, F.lit(1)))).otherwise(F.lit(0))
    above = upto(F.col("d") - 1) - upto(F.col("top"))
    whole, first = F.col("d") == F.col("depth"), F.col("d") == F.col("top") + 1
    return edge.select(
        "conv_id",
        F.col("d").alias("depth"),
        F.when(first, F.coalesce("parent_conv_id", "least")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(whole, F.col("n_children")).otherwise(F.lit(1)).alias("n_children"),
        "n_leaves",
        (F.col("saved") - (F.col("n") - 1) * above).alias("saved_tokens"),
        F.when(whole, F.coalesce("ends", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
