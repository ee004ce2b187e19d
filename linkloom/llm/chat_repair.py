"""Repair of conversations: the cheapest edits after which system (once, first), user and assistant take turns.

A retained-subsequence DP over the rows of a conversation, from its end to its start.
Its state is a row that stays and the role it has then, its own or the one it is given.
What lies between two rows that stay is deleted, at the difference of two prefix sums;
a running minimum per role of the row ahead holds the best of (cost behind that row +
prefix sum up to it), so each row looks at three of them and not at all later rows.
The pair of roles alone says what has to be inserted between. Of equal costs the
ASCII-least audit wins: deletions stand before insertions, so candidates first differ
in one letter, and the candidate further ahead (more D) or the lesser letter is taken.

On Spark, a conversation's texts meet in one task only to be hashed, as a sorted
stream. Before that, rows travel as a digest and two flags: earlier copies are found
by a grouping on (conversation, role, digest), rows are put in order within blocks of
turns, and a block becomes a string of one byte a row, which is all the DP reads. So
memory is a few bytes a row of one conversation, as is its audit, the answer itself.

Defined cases: a null role or text is one space; in the damage's key a null conv_id or
turn is one as well. A null conv_id is a conversation like any other. Rows are in order
of turn (nulls first), then role, then the digest of the text; copies of a row are
adjacent. A role of another initial than s, u or a (an empty role has none) can only be
given another role or deleted. Rows may repeat and texts be empty or very long: a text
is read whole and hashed where it lies. Empty tables give empty results; columns other
than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import releasing

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turn numbers of one conversation whose rows one task puts in order together, as a power of two.
BLOCK_BITS = 10
#: Rows of a block in one string.
CHUNK = 4096
#: A row as one character: its initial's class in "sua" or another (0 to 3) times 3, plus 0 sound, 1 truncated, 2 to be deleted.
CLASSES = "sua"
FIRST = 48
ROLES = {"u": "user", "a": "assistant"}
#: What stands between two retained roles, or a border ("^", "$") and one: letters of inserted roles. Absent: not allowed.
BETWEEN = {
    ("^", "s"): "", ("^", "u"): "", ("^", "a"): "u", ("^", "$"): "",
    ("s", "u"): "", ("s", "a"): "u", ("s", "$"): "ua",
    ("u", "u"): "a", ("u", "a"): "", ("u", "$"): "a",
    ("a", "u"): "", ("a", "a"): "u", ("a", "$"): "",
}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage: 0 drops a row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it the user's."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    hit = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), hit.alias("hit"))
    return rows.where("hit <> 0").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _ordered(rows: DataFrame, *keys: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys)


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, blank, cut, first): rows without their texts; ``first``: no row of an earlier turn has this role and text."""
    last = F.expr(r"right(trim(TRAILING ' \t\n\u000b\u000c\r' FROM text), 1)")
    small = rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), last.alias("last"))
    small = small.select("conv_id", "turn", "role", "digest", (F.col("last") == "").alias("blank"), (~F.col("last").isin(".", "!", "?")).alias("cut"))
    # null is the least turn: a struct's order puts it first
    since = small.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("since")).toDF("c", "r", "d", "since")
    joined = small.join(since, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    return joined.select(*small.columns, F.col("turn").eqNullSafe(F.col("since.turn")).alias("first"))


CODES = "conv_id long, block long, chunk int, codes string, low long, high long, n_turns long, blank long, duplicate long, truncated long"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, block, turn, role, digest) to strings of codes; of equal rows only the first is no duplicate."""
    names = [f.split()[0] for f in CODES.split(", ")]
    out, now, chunk, codes, tally, before = [], None, 0, [], None, None

    def close():
        if codes:
            out.append((*now, chunk, "".join(codes), *tally))

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for conv, block, turn, role, digest, blank, cut, first in zip(*columns):
            if (conv, block) != now or len(codes) >= CHUNK:
                close()
                same = (conv, block) == now
                now, chunk, codes, before = (conv, block), chunk + 1 if same else 0, [], before if same else None
                tally = [None, None, 0, 0, 0, 0]
            this = (turn, role, digest)
            copy = not first or this == before
            if turn is not None:
                tally[0] = turn if tally[0] is None else tally[0]
                tally[1] = turn
                tally[2] += before is None or before[0] != turn
            fault = 2 if blank or copy else int(cut)
            tally[3] += blank
            tally[4] += not blank and copy
            tally[5] += fault == 1
            codes.append(chr(FIRST + 3 * (CLASSES.find(role[:1]) if role[:1] in ("s", "u", "a") else 3) + fault))
            before = this
        if len(out) >= 1000:
            yield _rows(out, names, CODES)
            out = []
    close()
    if out:
        yield _rows(out, names, CODES)


def _rows(rows: list[tuple], names: list[str], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in ddl.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def cheapest(codes: str) -> tuple[int, str]:
    """(cost, audit) of a conversation whose rows have these codes."""
    n = len(codes)
    before = [0] * (n + 1)  # prefix sums of deletions
    for k in range(n):
        before[k + 1] = before[k] + DELETE
    # per role of a row ahead that stays: the least of cost behind it + prefix sum up to it, and that row; "$" is the end
    ahead: dict[str, tuple[int, int]] = {"$": (before[n], n)}
    letters: dict[tuple[int, str], str] = {}
    follows: dict[tuple[int, str], tuple[str, int]] = {}

    def best(role: str, k: int) -> tuple[int, str, int]:
        """The cheapest way on behind row ``k`` that has ``role``: (cost, role ahead, its row)."""
        found = None
        for q, (value, at) in ahead.items():
            between = BETWEEN.get((role, q))
            if between is None:
                continue
            letter = "I" if between else letters.get((at, q), "$")
            rank = (value - before[k + 1] + INSERT * len(between), -at, letter, q)
            if found is None or rank < found:
                found = rank
        return found[0], found[3], -found[1]

    for k in range(n - 1, -1, -1):
        kind, fault = divmod(ord(codes[k]) - FIRST, 3)
        if fault == 2:
            continue
        fresh = {}
        for role in ("s", "u", "a"):
            own = kind < 3 and CLASSES[kind] == role
            if role == "s" and not own:
                continue
            cost, q, at = best(role, k)
            cost += (0 if own else REROLE) + TRUNCATED * fault
            letters[k, role], follows[k, role] = "K" if own else "R", (q, at)
            fresh[role] = (cost + before[k], k)
        for role, entry in fresh.items():  # of equals the row further ahead stays: more deletions stand first
            if role not in ahead or entry[0] < ahead[role][0]:
                ahead[role] = entry
    cost, q, at = best("^", -1)
    audit, role, k = [], "^", -1
    while True:
        audit.append("D" * (at - k - 1) + "I" * len(BETWEEN[role, q]))
        if q == "$":
            return cost, "".join(audit)
        audit.append(letters[at, q])
        role, k = q, at
        q, at = follows[at, q]


def illegal(codes: str) -> int:
    kinds = [CLASSES[k] if (k := (ord(c) - FIRST) // 3) < 3 else "?" for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))


PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plans(conversations: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, and the cheapest edits."""
    rows = marked(damaged(conversations))
    rows = rows.select("conv_id", F.shiftright("turn", BLOCK_BITS).alias("block"), "turn", "role", "digest", "blank", "cut", "first")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "block", "turn", "role", "digest")]
    blocks = _ordered(rows, "conv_id", "block").sortWithinPartitions(*order).mapInArrow(releasing(_coded), CODES)
    sums = [F.sum(c).alias(c) for c in ("n_turns", "blank", "duplicate", "truncated")]
    codes = F.sort_array(F.collect_list(F.struct("block", "chunk", "codes")))
    whole = blocks.groupBy("conv_id").agg(F.array_join(F.transform(codes, lambda x: x["codes"]), "").alias("codes"), F.min("low").alias("low"), F.max("high").alias("high"), *sums)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0))
    judged = whole.select("conv_id", "codes", gaps.alias("gaps"), "blank", "duplicate", "truncated")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*cheapest(c), illegal(c)) for c in batch.column(1).to_pylist()]
            cost, audit, bad = zip(*found) if found else ((), (), ())
            columns = [batch.column(0), *batch.columns[2:], pa.array(bad, pa.int64()), pa.array(cost, pa.int64()), pa.array(audit, pa.string())]
            yield pa.record_batch(columns, names=[f.split()[0] for f in PLAN.split(", ")])

    return judged.mapInArrow(releasing(solve), PLAN)


def _lines(audit: str) -> Iterator[tuple[str, str]]:
    """(edit, role it makes) in order; a deletion makes none, a kept row's own role stays."""
    kept = sum(e != "D" for e in audit)
    place = -(kept % 2)  # with a system turn that one stands before the pairs
    for edit in audit:
        if edit == "D":
            yield edit, ""
        else:
            yield edit, ROLES["ua"[place % 2]]
            place += 1


def _repaired(emit, open_, close, ddl: str):
    """A task over rows sorted so that a conversation's plan comes first and its turns follow in order."""

    names = [f.split()[0] for f in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out = []  # a batch's rows, or the conversations that end in it
            for conv, plan, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "plan", "role", "text"))):
                if plan is not None:
                    if state is not None:
                        close(state, out)
                    state = open_(conv, plan)
                    continue
                for edit, given in state["edits"]:
                    if edit == "D":
                        break
                    emit(state, out, given if edit != "K" else role, "" if edit == "I" else text)
                    if edit != "I":
                        break
            if out:
                yield _rows(out, names, ddl)
        if state is not None:
            out = []
            close(state, out)
            if out:
                yield _rows(out, names, ddl)

    return run


def _streams(conversations: DataFrame) -> DataFrame:
    """Plans and damaged rows in one sorted stream per partition: (conv_id, plan, role, text); the plan's row comes first."""
    found = plans(conversations)
    counts = [c.split()[0] for c in PLAN.split(", ")[1:-2]]
    everyone = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = everyone.join(found.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")), "left")
    plan = F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in [*counts, "cost"]], F.coalesce("audit", F.lit("")).alias("audit"))
    none = lambda kind: F.lit(None).cast(kind)
    heads = joined.select("conv_id", F.lit(0).alias("k"), plan.alias("plan"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"))
    kind = heads.schema["plan"].dataType.simpleString()
    rows = damaged(conversations).select("conv_id", F.lit(1).alias("k"), none(kind).alias("plan"), "turn", "role", _digest(F.col("text")).alias("digest"), "text")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "k", "turn", "role", "digest")]
    return _ordered(heads.unionByName(rows), "conv_id").sortWithinPartitions(*order).select("conv_id", "plan", "role", "text")


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations, a row per turn."""
    ddl = "conv_id long, position long, role string, text string"

    def emit(state, out, role, text):
        out.append((state["conv"], state["n"], role, text))
        state["n"] += 1

    def close(state, out):
        for edit, given in state["edits"]:  # what is inserted behind the last row
            if edit == "I":
                emit(state, out, given, "")

    return _streams(conversations).mapInArrow(releasing(_repaired(emit, lambda conv, plan: {"conv": conv, "n": 0, "edits": _lines(plan["audit"])}, close, ddl)), ddl)


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the edits' cost and audit, and the SHA-256 of the repaired turns, hashed as they pass."""
    names = [f.split()[0] for f in RESULT.split(", ")]

    def open_(conv, plan):
        return {"conv": conv, "plan": plan, "edits": _lines(plan["audit"]), "hash": hashlib.sha256(), "n": 0}

    def emit(state, out, role, text):
        state["hash"].update(f"{chr(10) if state['n'] else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        state["n"] += 1

    def close(state, out):
        for edit, given in state["edits"]:
            if edit == "I":
                emit(state, out, given, "")
        plan = state["plan"]
        out.append((state["conv"], *[plan[c] for c in names[1:-1]], state["hash"].hexdigest()))

    return _streams(conversations).mapInArrow(releasing(_repaired(emit, open_, close, RESULT)), RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
