"""Removal of repeated byte strings by prefix doubling over sampled suffixes.

A byte goes if a string of ``LENGTH`` (50) bytes that covers it also starts in a
document with a smaller doc_id. Ranking every suffix would move each byte of the
corpus many times, so only some suffixes are ranked, chosen by content: the least
hash of the 5-byte strings in a 50-byte window picks one of the window's 28-byte
strings, its anchor (a mod-minimizer). Equal windows have equal anchors, so
ranking the anchors loses nothing.

Round 1 ranks anchors by their 28 bytes: Spark sorts (rank, position), and what no
smaller document shares is dropped. With it stands the rank of the whole stretch
of windows that have this anchor; equal stretches settle all of their windows at
once. Round 2 sorts pairs: the open anchors' ranks with those of the 11 bytes before
or after, so they cover 39 bytes, and drops again. Round 3 doubles: the windows that
are left are sorted by the pair of the ranks of their 25 bytes and of the 25 at
offset 25. The ranks that are paired are 64-bit hashes of the strings that they name
(of stretches 52 bits, beside the anchor's 64); a byte goes by a pair, never by one.

A rank that very many documents share does not gather them in one task: rows that
share it within a lot settle there that they stay open, and one of them travels for
all, so at most one row per lot and rank meets the others.

Positions travel, texts do not: rows are known by file and row number, and what
belongs to them is written in folders by file, sorted by row, in the shared
folder, where each task reads what its own rows need.

Defined cases: null texts are empty; texts shorter than 50 bytes lose nothing;
very long texts are cut into overlapping stretches of bounded size. Rows with equal
doc_id are documents of their own, neither smaller than the other; a null doc_id
is larger than any. Empty tables give empty results. Extra columns pass through
``remove_repeats``; only there they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.beside import RUN, Beside, file_numbers, numbered, rids_of, runs_with, write_beside
from linkloom.llm.common import releasing, written
from linkloom.llm.shingles import mixed, text_bytes

LENGTH = 50
#: Bytes of an anchor, and of the strings whose least hash picks it.
ANCHOR, SEED = 28, 5
#: Places that an anchor can have in a window.
PLACES = LENGTH - ANCHOR + 1
#: Every window holds its anchor with so many bytes before it, or with so many after it.
SIDE = (LENGTH - ANCHOR) // 2
#: Bytes that are hashed at once; longer texts are taken in stretches of that many window starts.
STRETCH = 1 << 18
#: Anchors that a task combines before they travel.
LOT = 200_000
LAST_DOC = 2**63 - 1


class _Hasher:
    """Hashes of substrings of one buffer: polynomial prefix sums modulo 2^64 with an odd base."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)
    powers = inverses = table = None

    def __init__(self, data):
        import numpy as np

        cls, n = type(self), len(data)
        if cls.table is None:
            cls.table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        if cls.powers is None or len(cls.powers) <= n:
            size = max(n + 1, STRETCH + 4 * LENGTH)
            for name, base in (("powers", cls.BASE), ("inverses", cls.INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(cls.table[data] * cls.powers[:n], out=self.sums[1:])

    def of(self, starts, lengths):
        """Hash of each substring; its length takes part."""
        import numpy as np

        ends = starts + lengths
        plain = (self.sums[ends] - self.sums[starts]) * self.inverses[starts]
        return mixed(plain + np.asarray(lengths).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _stretches(rows: Iterator[tuple[int, int, bytes]], overlap: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Groups of (rid, doc, place in the text, bytes) of bounded size; a long text's stretches overlap."""
    group, held = [], 0
    for rid, doc, data in rows:
        at = 0
        while True:
            part = data[at : at + STRETCH + overlap]
            group.append((rid, doc, at, part))
            held += len(part)
            if held >= STRETCH:
                yield group
                group, held = [], 0
            at += STRETCH
            if at + overlap >= len(data):
                break
    if group:
        yield group


def _anchors(group: list[tuple[int, int, int, bytes]]):
    """Of each stretch of windows with one anchor: rid, doc, first window, rank of the anchor, name of the stretch.

    The name's low bits are the number of windows less one and the anchor's place
    after the first window, six each; equal stretches have equal names.
    """
    import numpy as np

    none = np.zeros(0, np.int64)
    empty = (none, none, none, none.view(np.uint64), none.view(np.uint64))
    data = np.frombuffer(b"".join(p for *_, p in group), np.uint8)
    if len(data) < LENGTH:
        return empty
    sizes = np.asarray([len(p) for *_, p in group], np.int64)
    begins = np.cumsum(sizes) - sizes
    sums = _Hasher(data)
    # the least hash of a window's seeds, leftmost where equal: the place stands in the low bits
    places = np.arange(len(data) - SEED + 1)
    least = (sums.of(places, SEED) & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    span, width = LENGTH - SEED + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    starts = np.arange(len(least))
    part = np.repeat(np.arange(len(group)), sizes)[: len(least)]
    inside = starts + LENGTH <= (begins + sizes)[part]
    starts, part = starts[inside], part[inside]
    if not len(starts):
        return empty
    where = starts + ((least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64) - starts) % PLACES
    new = np.concatenate([[True], (where[1:] != where[:-1]) | (part[1:] != part[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    begin, more, anchor, part = starts[first], starts[last] - starts[first], where[first], part[first]
    rids, docs, offsets = (np.asarray([g[k] for g in group], np.int64) for k in range(3))
    after = anchor - begin
    low = (more << 6 | after).astype(np.uint64)
    name = (sums.of(begin, more + LENGTH) & ~np.uint64(0xFFF)) | low
    return rids[part], docs[part], begin - begins[part] + offsets[part], sums.of(anchor, np.full(len(anchor), ANCHOR)), name


def _settled_here(rank, doc):
    """Of rows with ranks: whether a smaller document in the same lot has the rank."""
    import numpy as np

    order = np.lexsort((doc, rank))
    r, d = rank[order], doc[order]
    first = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.zeros(0, bool)
    least = d[first][np.cumsum(first) - 1] if len(r) else d
    out = np.zeros(len(r), bool)
    out[order] = d > least
    return out


def _travellers(ranks: tuple, doc):
    """Of rows with ranks: which are sent to meet those of other lots, and which are known to share theirs with another document.

    Of rows that share their ranks in this lot only the one with the least document is sent.
    """
    import numpy as np

    order = np.lexsort((doc, *ranks[::-1]))
    d, first = doc[order], np.zeros(len(doc), bool)
    if len(doc):
        first[0] = True
        for r in ranks:
            first[1:] |= r[order][1:] != r[order][:-1]
    begins = np.flatnonzero(first)
    ends = np.append(begins[1:], len(doc))
    shared = np.repeat(d[ends - 1] > d[begins], ends - begins) if len(doc) else first
    sent, known = np.ones(len(doc), bool), np.zeros(len(doc), bool)
    sent[order] = ~shared | first
    known[order] = shared
    return sent, known


#: Added to a place that stands for others of its lot.
KNOWN = 1 << 40


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
        yield rid, LAST_DOC if doc is None else doc, text_bytes(text)


def _merged(rid, at, n):
    """Marks of rows joined where they touch: rid, at, n, sorted."""
    import numpy as np

    order = np.lexsort((at, rid))
    rid, at, n = rid[order], at[order], n[order]
    if not len(rid):
        return rid, at, n
    end = at + n
    # the furthest end so far within a row: rows are kept apart by a large step
    row = np.cumsum(np.concatenate([[True], rid[1:] != rid[:-1]])) - 1
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + row * step) - row * step
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rid)) - 1
    return rid[first], at[first], reach[last] - at[first]


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in columns], names=[c.split()[0] for c in names.split(", ")])


def _round_1(texts: DataFrame) -> DataFrame:
    """Written rows (kind, rid, doc, at, n, after): kind 0 marks n bytes, 1 is an open stretch."""
    names = "rank long, name long, doc long, rid long, at long"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def lots():
            """Anchors in lots of bounded size."""
            found, held = [], 0
            for batch in batches:
                for g in _stretches(_texts(batch), LENGTH - 1):
                    found.append(_anchors(g))
                    held += len(found[-1][0])
                    if held >= LOT:
                        yield found
                        found, held = [], 0
            if found:
                yield found

        for found in lots():
            rid, doc, at, rank, name = (np.concatenate(c) for c in zip(*found))
            here = _settled_here(mixed(rank * np.uint64(3) + name), doc)
            mark = _merged(rid[here], at[here], (name[here].astype(np.int64) >> 6 & 63) + LENGTH)
            rid, doc, at, rank, name = (c[~here] for c in (rid, doc, at, rank, name))
            sent, known = _travellers((rank,), doc)
            yield _batch(names, rank[sent].view(np.int64), name[sent].view(np.int64), doc[sent], rid[sent], at[sent] + KNOWN * known[sent])
            # marks, and what stays open anyway, go along under any rank, with a negative place; only marks have no document
            rest, n = ~sent, len(mark[0])
            spread = lambda x: mixed(x.astype(np.uint64) + np.arange(len(x), dtype=np.uint64)).view(np.int64)
            yield _batch(names, spread(rid[rest]), name[rest].view(np.int64), doc[rest], rid[rest], -1 - at[rest] - KNOWN)
            yield _batch(names, spread(mark[0]), mark[2], np.zeros(n, np.int64), mark[0], -1 - mark[1])

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one exchange and one sort serve both windows
    rows = texts.mapInArrow(releasing(emit), names).repartition(n, "rank").sortWithinPartitions("rank", "name")
    outer, inner = Window.partitionBy("rank"), Window.partitionBy("rank", "name")
    real, known = F.col("at") >= 0, F.col("at") >= KNOWN
    passing = F.col("at") < -KNOWN
    doc, name = F.when(real, F.col("doc")), F.when(real, F.col("name"))
    rows = rows.withColumn("least_2", F.min(doc).over(inner)).withColumns(
        {
            "least_1": F.min(doc).over(outer), "most": F.max(doc).over(outer), "w0": F.min(name).over(outer), "w1": F.max(name).over(outer),
            "more_here": F.max(known).over(outer),
        }
    )
    copied = real & (F.col("doc") > F.col("least_2"))
    shared = F.col("more_here") | ((F.col("least_1") < F.col("most")) & (copied | (F.col("w0") < F.col("w1"))))
    kept = rows.where(~real | shared)
    more = F.shiftright("name", 6).bitwiseAND(F.lit(63))
    return written(
        kept.select(
            F.when((~real & ~passing) | copied, 0).otherwise(1).alias("kind"),
            "rid",
            "doc",
            F.when(known, F.col("at") - KNOWN).when(real, F.col("at")).when(passing, -1 - F.col("at") - KNOWN).otherwise(-1 - F.col("at")).alias("at"),
            F.when(~real & ~passing, F.col("name")).when(copied, more + LENGTH).otherwise(more).alias("n"),
            F.col("name").bitwiseAND(F.lit(63)).alias("after"),
        ),
        "anchors",
    )


def _round_2(texts: DataFrame, open_rows: DataFrame) -> DataFrame:
    """Written rows (rid, doc, at, n): parts of stretches whose 39 bytes another document shares."""
    path = write_beside(open_rows, "open")
    names = "rank long, side long, rid long, doc long, at long, n long"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        beside = Beside(path)
        for data, offsets, of, found in _with_beside(batches, beside):
            rid, doc, at, n, after = (found[c].to_numpy() for c in ("rid", "doc", "at", "n", "after"))
            anchor = offsets[of] + at + after
            # windows whose anchor has at most SIDE bytes before it end beyond the anchor by SIDE; the others start before it by SIDE
            split = np.clip(after - SIDE, 0, n + 1)  # windows of the left part
            rows = []
            for left in (True, False):
                has = split > 0 if left else split <= n
                start = anchor[has]
                rank = _long_hash(data, start, np.full(len(start), ANCHOR))
                side = _long_hash(data, start - SIDE if left else start + ANCHOR, np.full(len(start), SIDE)) ^ np.uint64(left)
                rows.append((rank, side, rid[has], doc[has], at[has] + (0 if left else split[has]), (split[has] - 1) if left else (n - split)[has]))
            rank, side, rid, doc, at, n = (np.concatenate(c) for c in zip(*rows))
            sent, known = _travellers((rank, side), doc)
            yield _batch(names, rank[sent].view(np.int64), side[sent].view(np.int64), rid[sent], doc[sent], at[sent] + KNOWN * known[sent], n[sent])
            rest = ~sent
            spread = mixed(rid[rest].astype(np.uint64) + np.arange(int(rest.sum()), dtype=np.uint64)).view(np.int64)
            yield _batch(names, spread, side[rest].view(np.int64), rid[rest], doc[rest], -1 - at[rest], n[rest])

    ranked = texts.mapInArrow(releasing(emit), names)
    over, real, known = Window.partitionBy("rank", "side"), F.col("at") >= 0, F.col("at") >= KNOWN
    doc = F.when(real, F.col("doc"))
    ranked = ranked.withColumns({"least": F.min(doc).over(over), "most": F.max(doc).over(over), "more_here": F.max(known).over(over)})
    ranked = ranked.where(~real | F.col("more_here") | (F.col("least") < F.col("most")))
    at = F.when(known, F.col("at") - KNOWN).when(real, F.col("at")).otherwise(-1 - F.col("at"))
    return written(ranked.select("rid", "doc", at.alias("at"), "n"), "pairs")


def _round_3(texts: DataFrame, open_rows: DataFrame) -> DataFrame:
    """Marks (rid, at, n) of the single windows that a smaller document has, by the pair of the ranks of their halves."""
    path = write_beside(open_rows, "pairs")
    names = "rank long, next long, doc long, rid long, at long"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        beside, half = Beside(path), LENGTH // 2
        for data, offsets, of, found in _with_beside(batches, beside):
            n = found["n"].to_numpy() + 1
            nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(found["at"].to_numpy(), n) + nth
            start = np.repeat(offsets[of], n) + at
            rank, after = (_long_hash(data, start + k, np.full(len(start), half)) for k in (0, half))
            doc, rid = (np.repeat(found[c].to_numpy(), n) for c in ("doc", "rid"))
            here = _settled_here(mixed(rank * np.uint64(3) + after), doc)
            mark = _merged(rid[here], at[here], np.full(int(here.sum()), LENGTH))
            # of windows that are equal within this lot, one of the least document meets the others, unless one document has several
            rest, m = ~here, len(mark[0])
            yield _batch(names, rank[rest].view(np.int64), after[rest].view(np.int64), doc[rest], rid[rest], at[rest])
            spread = mixed(mark[0].astype(np.uint64) + np.arange(m, dtype=np.uint64)).view(np.int64)
            yield _batch(names, spread, mark[2], np.zeros(m, np.int64), mark[0], -1 - mark[1])

    ranked = texts.mapInArrow(releasing(emit), names)
    real = F.col("at") >= 0
    # marks have a negative place, and their length in place of the second rank
    ranked = ranked.withColumn("least", F.min(F.when(real, F.col("doc"))).over(Window.partitionBy("rank", "next")))
    ranked = ranked.where(~real | (F.col("doc") > F.col("least")))
    return ranked.select("rid", F.when(real, F.col("at")).otherwise(-1 - F.col("at")).alias("at"), F.when(real, LENGTH).otherwise(F.col("next")).cast("long").alias("n"))


def _long_hash(data, starts, lengths):
    """Hashes of substrings of a buffer of any length, taken in bounded parts; each substring is short."""
    import numpy as np

    out = np.zeros(len(starts), np.uint64)
    order = np.argsort(starts, kind="stable")
    k = 0
    while k < len(order):
        lo = int(starts[order[k]])
        last = int(np.searchsorted(starts[order], lo + STRETCH, "right"))
        own = order[k:last]
        sums = _Hasher(data[lo : int((starts[own] + lengths[own]).max())])
        out[own] = sums.of(starts[own] - lo, lengths[own])
        k = last
    return out


def _with_beside(batches, beside: Beside):
    """Of each run of rows with rows beside them: their texts as one buffer, where each text starts, the text of each found row, the found rows."""
    import numpy as np

    for run, of, found in runs_with(batches, beside):
        parts = [d for _, _, d in _texts(run)]
        sizes = np.asarray([len(p) for p in parts], np.int64)
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, of, found


def _marked(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """``docs`` read from files, its numbered rows, and the folder with the marks beside them."""
    docs, texts = numbered(docs)
    first = _round_1(texts)
    second = _round_2(texts, first.where("kind > 0"))
    third = _round_3(texts, second)
    marks = first.where("kind = 0").select("rid", "at", "n").unionByName(third)
    return docs, texts, write_beside(marks, "marks")


def _removed(batch: pa.RecordBatch, beside: Beside) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Of each row of a batch: its bytes and the runs (begin, end) that go."""
    import numpy as np

    found = beside.rows(batch.column(0).to_pylist())
    rid, at, n = _merged(*(found[c].to_numpy() for c in ("rid", "at", "n"))) if found is not None else (np.zeros(0, np.int64),) * 3
    for r, _, data in _texts(batch):
        lo, hi = np.searchsorted(rid, r, "left"), np.searchsorted(rid, r, "right")
        yield data, [(int(a), int(a + k)) for a, k in zip(at[lo:hi], n[lo:hi])]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, RUN):
            yield batch.slice(at, RUN)


def _rest(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def removals(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (begin and end of each removed run), kept (the remaining bytes)."""
    _, texts, path = _marked(docs)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Beside(path)
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for run in _runs(batches):
            out = list(_removed(run, beside))
            spans = pa.array([[{"begin": a, "end": b} for a, b in runs] for _, runs in out], kind)
            yield pa.record_batch(
                [run.column(1), pa.array([len(d) for d, _ in out], pa.int64()), spans, pa.array([_rest(*x) for x in out], pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return texts.mapInArrow(releasing(remove), "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with what remains of each text; ``n_chars``, where there is such a column, follows it.

    A run may end within a character: what is left of that character goes too, so texts stay text.
    """
    docs, _, path = _marked(docs)
    names = docs.columns
    inner = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    at, numbers = names.index("text"), file_numbers(docs)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Beside(path)
        for batch in _runs(batches):
            rids = rids_of(batch.column("f"), batch.column("r"), numbers.value)
            own = pa.record_batch([pa.array(rids, pa.int64()), pa.array(rids, pa.int64()), batch.column(at)], names=["rid", "doc", "text"])
            kept = []
            for was, (data, runs) in zip(batch.column(at), _removed(own, beside)):
                kept.append(_rest(data, runs).decode("utf-8", "ignore") if runs else was.as_py())
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(kept, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in kept]).cast(columns[k].type)
            yield pa.record_batch(columns, names=batch.schema.names[: len(names)])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    out = inner.mapInArrow(releasing(remove), schema)
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return rows.select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
