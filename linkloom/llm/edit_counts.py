"""Edit-aware token counts: a segment tree per document over spans of pre-tokens.

A text is cut into leaves where the tokenizer certainly cuts it: before a run of
white space that follows other characters; a leaf is a run of whole pre-tokens of at
least ``LEAF_CHARS`` characters together. Inner nodes hold the sums of characters
and tokens below them. An edit finds the leaves it touches by descending the tree,
joins them with one leaf on either side as context, cuts and encodes that region
again, and updates the sums on the way up; the rest of the text is never encoded
again. The first edits of a group of documents are counted in one go, then the second
ones, and so on; words of a region that were counted with the text are looked up. A slot may come to hold several leaves, or none; once one holds more than
``MOST_LEAVES``, the leaves are dealt anew to a tree of their own number, by the
counts that they have, so edits at one place stay as cheap as any.

Defined cases: a null text is empty and has 0 tokens. Edits beyond the end act at
the end; a null deletion or insertion is none. A text without white space is one
leaf, however long. Repeated rows are handled one by one; empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import releasing
from linkloom.llm.encoding import counter, grouped

#: Characters of a leaf at least; it ends at the next certain cut.
LEAF_CHARS = 512
#: Leaves of a slot from which on the tree is built anew.
MOST_LEAVES = 4
CUT = re.compile(r"(?<=\S)(?=\s)")
SCHEMA = "doc_id long, n_edits long, tokens_before long, tokens_after long, chars_after long, reencoded_chars long, text_crc32 long"
EDITS = "array<struct<pos:bigint,del:bigint,ins:string>>"


def leaves(text: str, least: int = LEAF_CHARS) -> list[str]:
    """The text's spans, each but the last of at least so many characters."""
    out, at = [], 0
    while at < len(text):
        m = CUT.search(text, at + least) if at + least < len(text) else None
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


class TokenTree:
    """Counts of one document; ``count`` maps a list of spans to their token counts."""

    def __init__(self, text: str, count, least: int = LEAF_CHARS, counts: list[int] | None = None):
        self.count, self.least, self.reencoded = count, least, 0
        spans = leaves(text, least) or [""]
        if counts is None:
            counts = count(spans)
        self._build(list(zip(spans, counts, strict=True)))

    def _build(self, leaves_: list[tuple[str, int]]) -> None:
        """A tree with a slot for each leaf (its span and tokens)."""
        self.slots: list[list[tuple[str, int]]] = [[x] for x in leaves_]
        self.size = 1
        while self.size < len(leaves_):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (s, n) in enumerate(leaves_):
            self.chars[self.size + k], self.tokens[self.size + k] = len(s), n
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def leaf_counts(self) -> list[int]:
        return [n for slot in self.slots for _, n in slot]

    def text(self) -> str:
        return "".join(s for slot in self.slots for s, _ in slot)

    def _find(self, pos: int) -> tuple[int, int]:
        """The slot that holds character ``pos``, and the characters before it."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if pos - before >= self.chars[k] and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return min(k - self.size, len(self.slots) - 1), before

    def _beside(self, slot: int, step: int) -> int:
        """The nearest slot with text on that side, or the last one there."""
        k = slot + step
        while 0 < k < len(self.slots) - 1 and not self.chars[self.size + k]:
            k += step
        return min(max(k, 0), len(self.slots) - 1)

    def _set(self, slot: int, own: list[tuple[str, int]]) -> None:
        self.slots[slot] = own
        k = self.size + slot
        chars, had = sum(len(s) for s, _ in own) - self.chars[k], sum(n for _, n in own) - self.tokens[k]
        while k:
            self.chars[k] += chars
            self.tokens[k] += had
            k //= 2

    def edit(self, pos: int, delete: int, insert: str) -> None:
        lo, hi, made = self.region(pos, delete, insert)
        todo = [s for s, n in made if n is None]
        self.put(lo, hi, made, iter(self.count(todo) if todo else []))

    def region(self, pos: int, delete: int, insert: str) -> tuple[int, int, list[tuple[str, int | None]]]:
        """The first and last slot that an edit changes, context included, and the leaves that they are to hold, with the tokens of those that were there before."""
        total = self.chars[1]
        pos = min(max(pos, 0), total)
        delete = min(max(delete, 0), total - pos)
        first, last = self._find(max(pos - 1, 0))[0], self._find(min(pos + delete, max(total - 1, 0)))[0]
        lo, hi = self._beside(first, -1), self._beside(last, 1)
        lo, hi = min(lo, first), max(hi, last)
        start = self._start(lo)
        old = "".join(s for slot in self.slots[lo : hi + 1] for s, _ in slot)
        at = pos - start
        new = old[:at] + insert + old[at + delete :]
        had = dict(x for slot in self.slots[lo : hi + 1] for x in slot)
        return lo, hi, [(s, had.get(s)) for s in leaves(new, self.least)]

    def put(self, lo: int, hi: int, made: list[tuple[str, int | None]], counts: Iterator[int]) -> None:
        """Sets the leaves of a region; ``counts`` gives the tokens of those that have none yet."""
        made = [(s, next(counts) if n is None else n) for s, n in made]
        self.reencoded += sum(len(s) for s, _ in made)
        # the leaves are dealt over the slots of the region, the rest to its last slot
        width = hi - lo + 1
        for k in range(width):
            self._set(lo + k, made[k : k + 1] if k < width - 1 else made[k:])
        if len(self.slots[hi]) > MOST_LEAVES:
            self._build([x for slot in self.slots for x in slot])

    def _start(self, slot: int) -> int:
        """Characters before a slot, by climbing."""
        k, before = self.size + slot, 0
        while k > 1:
            if k % 2:
                before += self.chars[k - 1]
            k //= 2
        return before


def edited_counts(docs: DataFrame, tokenizer: str, least: int = LEAF_CHARS, kept: str | None = None) -> DataFrame:
    """``docs`` has doc_id, text and ``edits`` (an array of pos, del, ins, applied in order).

    ``kept`` names a column with what ``trees`` returned for the texts, a struct of
    leaf_tokens and signature: only the regions of edits are encoded then. Where it is
    null, or its signature is not that of the text, its leaves and their counts, the
    text is encoded once before, as without it.
    """
    tree = F.col(f"`{kept}`") if kept else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("edits").cast(EDITS).alias("edits"), tree.cast("struct<leaf_tokens:array<bigint>,signature:bigint>").alias("tree"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        count = counter(tokenizer)
        for batch in batches:
            out = []
            for group in grouped(_read(batch), lambda row: len(row[1]) + sum(len(ins) for _, _, ins in row[2])):
                for (doc, _, todo, _), (tree, before) in zip(group, _edited(group, count, least), strict=True):
                    out.append((doc, len(todo), before, tree.tokens[1], tree.chars[1], tree.reencoded, zlib.crc32(tree.text().encode())))
            columns = zip(*out) if out else [[]] * 7
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(releasing(apply), SCHEMA)


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    """doc_id, text, edits and what is kept of the tree, for each row."""
    for doc, text, edits, was in zip(*(batch.column(i) for i in range(4))):
        todo = [(e["pos"] or 0, e["del"] or 0, e["ins"] or "") for e in edits.as_py() or [] if e is not None]
        yield doc.as_py(), text.as_py() or "", todo, was.as_py()


def _edited(rows: list[tuple], count, least: int) -> list[tuple[TokenTree, int]]:
    """The tree of each row after its edits, and its tokens before them."""
    kept = [was["leaf_tokens"] if was else None for *_, was in rows]
    for k, (_, text, _, was) in enumerate(rows):
        if kept[k] is not None and was["signature"] != signature(text, kept[k], least):
            kept[k] = None
    fresh = iter(_leaf_counts([text for (_, text, _, _), own in zip(rows, kept) if own is None], count, least))
    trees_ = [TokenTree(text, count, least, next(fresh) if own is None else own) for (_, text, _, _), own in zip(rows, kept)]
    found, k = [(tree, tree.tokens[1]) for tree in trees_], 0
    live = [(tree, todo) for tree, (_, _, todo, _) in zip(trees_, rows)]
    while live := [(tree, todo) for tree, todo in live if k < len(todo)]:
        regions = [tree.region(*todo[k]) for tree, todo in live]
        counts = iter(count([s for _, _, made in regions for s, n in made if n is None]))
        for (tree, _), (lo, hi, made) in zip(live, regions):
            tree.put(lo, hi, made, counts)
        k += 1
    return found


def _leaf_counts(texts: list[str], count, least: int) -> list[list[int]]:
    spans = [leaves(t, least) or [""] for t in texts]
    counts = iter(count([s for own in spans for s in own]))
    return [list(islice(counts, len(own))) for own in spans]


def signature(text: str, counts: list[int], least: int) -> int:
    """Tells whether counts were made for this text and these leaves."""
    import zlib

    return zlib.crc32(",".join(map(str, [least, *counts])).encode(), zlib.crc32(text.encode()))


def trees(docs: DataFrame, tokenizer: str, least: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ``leaf_tokens`` and ``signature``: what has to be kept of a document's tree; the leaves follow from the text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            counts = [own for group in grouped(texts, len) for own in _leaf_counts(group, count, least)]
            signed = [signature(t, c, least) for t, c in zip(texts, counts)]
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.list_(pa.int64())), pa.array(signed, pa.int64())], names=["doc_id", "leaf_tokens", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(build), "doc_id long, leaf_tokens array<long>, signature long")


def scripted_edits(doc_id: Column, text: Column) -> Column:
    """The query's edits, three for each document: an insertion, a deletion and a replacement at hashed places."""
    n = F.length(F.coalesce(text, F.lit("")))
    at = lambda k: F.pmod(F.xxhash64(F.lit(k), doc_id), F.greatest(n, F.lit(1)).cast("long"))
    edit = lambda pos, cut, ins: F.struct(pos.alias("pos"), F.lit(cut).cast("long").alias("del"), F.lit(ins).alias("ins"))
    return F.array(edit(at(1), 0, " and more words,\nthen"), edit(at(2), 40, ""), edit(at(3), 7, "edited"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text", scripted_edits(F.col("doc_id"), F.col("text")).alias("edits"))
    return edited_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
