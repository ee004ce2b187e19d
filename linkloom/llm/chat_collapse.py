"""Chat formatting: logged snapshots that a longer log continues are collapsed before rendering.

A conversation's prefix up to a turn has a rolling hash: the sums of the hashes
of (turn, role, text) over all its rows up to that turn. Sums add up, so a
conversation of any length is summed in blocks of turns, and no task needs all of
its rows. A conversation is dropped when another one has an equal prefix and goes
on, or is equal to it and has the smaller id; an anti-join keeps the rest.

Defined cases: rows with a null conv_id belong to no conversation and are left
out; a null turn counts as turn -1, a null role or text as empty. Rows that share
a turn are one step; repeated rows count as often as they stand there. Empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one conversation that are summed together before the blocks are.
BLOCK = 32
SUMS = ("a_hi", "a_lo", "b_hi", "b_lo", "n")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id is not null").select(
        "conv_id",
        F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """One row per conversation and turn: the sums over its rows up to that turn, and its last turn.

    Two 64-bit hashes of each row are summed by halves, so the sums cannot overflow.
    """
    keys = ("turn", "role", "text")
    hashed = _turns(conversations).select(
        "conv_id", "turn", F.xxhash64(*keys).alias("a"), F.xxhash64(F.lit("second"), *keys).alias("b")
    )
    half = lambda c, hi: F.shiftrightunsigned(c, 32) if hi else F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    sums = [F.sum(half(c, hi)).alias(f"{c}_{'hi' if hi else 'lo'}") for c in "ab" for hi in (True, False)]
    steps = hashed.groupBy("conv_id", "turn").agg(*sums, F.count("*").alias("n"))
    steps = steps.withColumn("blk", F.floor(F.col("turn") / BLOCK))
    upto = Window.partitionBy("conv_id", "blk").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    inner = steps.select("conv_id", "turn", "blk", *[F.sum(s).over(upto).alias(s) for s in SUMS])
    blocks = steps.groupBy("conv_id", "blk").agg(*[F.sum(s).alias(s) for s in SUMS], F.max("turn").alias("top"))
    earlier = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    before = blocks.select(
        "conv_id",
        "blk",
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_0") for s in SUMS],
        F.max("top").over(whole).alias("last_turn"),
    )
    joined = inner.join(before, ["conv_id", "blk"])
    return joined.select("conv_id", "turn", "last_turn", *[(F.col(s) + F.col(f"{s}_0")).alias(s) for s in SUMS])


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_snapshots: the conversations that remain; n_snapshots counts equal logs, itself included."""
    prefixes = prefix_hashes(conversations)
    key = [*SUMS, "turn"]
    full = prefixes.where("turn = last_turn").groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_snapshots")
    )
    continued = prefixes.where("turn < last_turn").select(*key).distinct()
    return full.join(continued, key, "left_anti").select("conv_id", "n_snapshots")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE), F.lit("\n"))


def render(conversations: DataFrame) -> DataFrame:
    """One row per turn row of each maximal conversation: conv_id, turn, n_snapshots, rendered.

    The segments in order of (turn, rendered) are the conversation; they stay rows,
    as one conversation may be longer than a task can hold.
    """
    turns = _turns(conversations).select("conv_id", "turn", rendered(F.col("role"), F.col("text")).alias("rendered"))
    return turns.join(maximal(conversations), "conv_id").select("conv_id", "turn", "n_snapshots", "rendered")


def assemble(segments: DataFrame) -> DataFrame:
    """conv_id, conversation: whole strings, for conversations that fit a task."""
    parts = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "rendered"))).alias("s"))
    return parts.select("conv_id", F.array_join(F.col("s.rendered"), "").alias("conversation"))


def query(spark, sf_dir: str) -> DataFrame:
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS rows,
         list(DISTINCT turn) AS turns
  FROM t GROUP BY conv_id
), p AS (
  SELECT DISTINCT list_filter(rows, lambda r: r.turn <= k.cut) AS rows
  FROM (SELECT rows, unnest(turns) AS cut, list_max(turns) AS last FROM c) k WHERE cut < last
), f AS (
  SELECT rows, min(conv_id) AS conv_id, count(*) AS n_snapshots FROM c GROUP BY rows
), m AS (
  SELECT conv_id, n_snapshots FROM f WHERE rows NOT IN (SELECT rows FROM p)
)
SELECT conv_id, turn, n_snapshots,
       '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
FROM t JOIN m USING (conv_id)
"""
