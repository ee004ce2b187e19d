"""Connected components of an edge table by alternating large-star and small-star steps.

Each step joins edges with the least neighbour of their nodes. That is an aggregate
combined before its exchange; a node with more than its share of all edges gets its
least neighbour by a broadcast instead of a shuffle, and there can only be a few
times as many such nodes as there are partitions. Nothing is collected but two
numbers per round. Nodes are longs; a null node belongs to no component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import release, written


#: Nodes with more than 1 / (HOT * partitions) of all edge ends are brought their least neighbour by broadcast; below LEAST edges none is.
HOT, LEAST = 4, 1_000


def _star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """Links each larger (or smaller) neighbour of a node, and the node, to the least of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "a"))
    bound = max(LEAST, 2 * n_edges // (HOT * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    least = written(least, "least")
    hot = least.where(F.col("n") > bound).select("a", F.col("m").alias("hot"))  # HOT * partitions rows at most
    known = both.join(F.broadcast(hot), "a", "left")
    moved = known.where("hot is not null").select("a", "b", F.col("hot").alias("m"))
    moved = moved.unionByName(known.where("hot is null").select("a", "b").join(least.select("a", "m"), "a"))
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of an edge; ``edges`` has two columns of longs, the root is the least node."""
    a, b = edges.columns
    state = lambda df: df.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    was = state(now)
    for _ in range(rounds):
        middle = written(_star(now, True, was[0]), "edges")
        after = written(_star(middle, False, was[0]), "edges")
        same = state(after)
        release(middle, now)
        now = after
        if same == was:
            break
        was = same
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
