"""Benchmark decontamination by greedy string tiling.

Runs of ``min_match`` words that a document shares with a benchmark item are seeds.
Documents and items meet by a join on the hashes of seeds; each pair that meets is
compared: the longest common runs of words that are not yet marked are found by
running Karp-Rabin with falling search lengths, and marked as tiles, again and
again, until none of ``min_match`` words is left. The share of an item's words in
tiles is its coverage; order does not matter, so a passage whose parts were moved is
found as well.

Seeds of a document travel only if a Bloom filter of all items' seeds, of bounded
size, may hold them; a benchmark too large for the filter fills it more, and more
seeds travel, with the same result. A pair that reaches the threshold shares many of
the item's seeds, so each item leaves out as many of its most common ones as it can
spare: phrases that many items share bring no pairs together. The texts stay where
they are read; items travel to the documents that they meet, and nothing of
documents or items is gathered anywhere.

Defined cases: null and empty texts match nothing, nor do items without words. A
text is a sequence of words, runs of letters and digits in lower case; in scripts
that put no space between words each character is a word. An item of fewer than
``min_match`` words is no more than a phrase: it matches a document in which it
makes up a whole line. Very long texts and items are compared whole. Repeated rows
are judged one by one; rows of equal item_id are items of their own, and so are
those of a null item_id. Ties between tiles go to the first place in the text, then
in the item. Empty tables give empty results. Extra columns pass through
``drop_contaminated`` unchanged and are not read elsewhere.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.beside import beside_texts, kept_rows, numbered
from linkloom.llm.common import AT_END, releasing, written
from linkloom.llm.shingles import mixed

MIN_MATCH = 5
#: Of an item's words; half of an item in runs of five words is no chance.
THRESHOLD = 0.5
#: First search length; it doubles while longer matches are found.
SEARCH_FROM = 20
#: Bits of the seed filter: 16 for each seed, up to 64 MB.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 29
#: Words whose hashes a task keeps at most.
CACHE_WORDS = 150_000
#: Scripts that are written without spaces (Han, kana, Thai, Lao, Burmese, Khmer).
UNSPACED = "々-〇ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿฀-໿က-႟ក-៿\U00020000-\U0003134f"
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
ASCII_WORD = re.compile(r"[a-z0-9_]+")
SCHEMA = "doc_id long, item_id long, item_words long, matched_words long, n_tiles long, coverage double"
_cache: dict[str, int] = {}
AT_END.append(_cache.clear)


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return ASCII_WORD.findall(text) if text.isascii() else WORD.findall(text)


def _hashes(words: list[str]):
    """A 64-bit hash of each word."""
    import numpy as np
    import xxhash

    if len(_cache) > CACHE_WORDS:
        _cache.clear()
    for w in set(words).difference(_cache):
        _cache[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))


def seeds_of(ids, length: int):
    """Hash of each window of so many words; the length takes part. Empty where there are fewer words."""
    import numpy as np

    n = len(ids) - length + 1
    if n <= 0 or not length:
        return np.zeros(0, np.uint64)
    out = ids[:n].copy()
    for k in range(1, length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    return mixed(out + np.uint64(length))


def tiles(text: Sequence[int], item: Sequence[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id sequences: (place in text, place in item, length), longest first.

    A negative id in ``text`` matches nothing.
    """
    text, item = list(text), list(item)
    free_t, free_i = [x >= 0 for x in text], [True] * len(item)
    found: list[tuple[int, int, int]] = []
    search = max(min_match, min(SEARCH_FROM, len(item)))
    while True:
        matches, longest = _scan(text, item, free_t, free_i, search)
        if longest > 2 * search:
            search = longest
            continue
        heapq.heapify(matches)
        while matches:
            length, t, i = heapq.heappop(matches)
            length = -length
            k = 0
            while k < length:  # what earlier tiles have left of the match
                if not (free_t[t + k] and free_i[i + k]):
                    k += 1
                    continue
                n = 0
                while k + n < length and free_t[t + k + n] and free_i[i + k + n]:
                    n += 1
                if n == length:
                    for j in range(n):
                        free_t[t + j] = free_i[i + j] = False
                    found.append((t, i, n))
                elif n >= search:
                    heapq.heappush(matches, (-n, t + k, i + k))
                k += n
        if search == min_match:
            return found
        search = max(search // 2, min_match)


def _scan(text, item, free_t, free_i, search):
    """Maximal unmarked matches (-length, place in text, in item) of at least ``search``, and the longest length."""

    def runs(free):
        start = 0
        for k, f in enumerate([*free, False]):
            if not f:
                if k - start >= search:
                    yield start, k
                start = k + 1

    modulus, base = (1 << 61) - 1, 1_000_003
    top = pow(base, search - 1, modulus)

    def rolled(seq, free):
        for lo, hi in runs(free):
            h = 0
            for k in range(lo, hi):
                if k - lo >= search:
                    h = (h - (seq[k - search] + 1) * top) % modulus
                h = (h * base + seq[k] + 1) % modulus
                if k - lo + 1 >= search:
                    yield k - search + 1, h

    places = defaultdict(list)
    for at, h in rolled(item, free_i):
        places[h].append(at)
    matches, longest = [], 0
    if not places:
        return matches, longest
    ends: dict[int, int] = {}  # diagonal -> end of the last match on it
    for t, h in rolled(text, free_t):
        for i in places.get(h, ()):
            if ends.get(t - i, -1) > t:
                continue
            n = 0
            while t + n < len(text) and i + n < len(item) and free_t[t + n] and free_i[i + n] and text[t + n] == item[i + n]:
                n += 1
            if n >= search:
                matches.append((-n, t, i))
                ends[t - i] = t + n
                longest = max(longest, n)
    return matches, longest


def coverage(text: str, item: str, min_match: int = MIN_MATCH) -> tuple[int, int, int]:
    """(words of the item, words in tiles, tiles) of one document and one item, by the words that both have."""
    import numpy as np

    own = words_of(item)
    number: dict[str, int] = {}
    ids = np.asarray([number.setdefault(w, len(number)) for w in own], np.int64)
    m = min(min_match, len(ids))
    if m < min_match:
        lines = sum(words_of(line) == own for line in text.split("\n")) if own else 0
        return len(ids), len(ids) if lines else 0, min(lines, 1)
    get = number.get
    places = np.asarray([get(w, -1) for w in words_of(text)], np.int64)
    seeds, known = seeds_of(places.astype(np.uint64), m), np.unique(seeds_of(ids.astype(np.uint64), m))
    # tiles lie within runs of seeds: only those parts of the text are compared
    hits = np.flatnonzero(np.isin(seeds, known))
    parts, end = [], -1
    for p in hits.tolist():
        if p > end:
            parts.append(-1)
            end = p
        parts.extend(places[end : p + m].tolist())
        end = p + m
    found = tiles(parts, ids.tolist(), m)
    return len(ids), sum(n for _, _, n in found), len(found)


def needed_seeds(n_words: int, threshold: float, min_match: int) -> int:
    """The least number of an item's windows that a document shares once it covers ``threshold`` of the item: a tile of the least length holds one."""
    import math

    return max(1, math.ceil(math.ceil(threshold * n_words - 1e-9) / min_match))


def item_seeds(items: DataFrame, threshold: float, min_match: int) -> DataFrame:
    """(seed, item, short): for each item the windows that candidates are found by, its most common ones left out as far as it can spare them.

    ``items`` has item (a number of its own for each row) and text.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            seeds, owners, spare, short = [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = _hashes(words_of(text))
                if not len(ids):
                    continue
                m = min(min_match, len(ids))
                own, times = np.unique(seeds_of(ids, m), return_counts=True)
                # a window that stands twice counts twice, so only spare ones that stand once may go
                need = needed_seeds(len(ids), threshold, min_match)
                seeds.append(own.view(np.int64))
                owners.append(np.full(len(own), item, np.int64))
                spare.append(np.full(len(own), max(0, need - 1) // int(times.max()), np.int64))
                short.append(np.full(len(own), m < min_match))
            if seeds:
                columns = [pa.array(np.concatenate(c)) for c in (seeds, owners, spare, short)]
                yield pa.record_batch(columns, names=["seed", "item", "spare", "short"])

    rows = written(items.select("item", "text").mapInArrow(releasing(emit), "seed long, item long, spare long, short boolean"), "item-seeds")
    shared = rows.groupBy("seed").agg(F.count("*").alias("times"))
    by_item = rows.join(shared, "seed").groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("times")).alias("t"), "seed"))).alias("seeds"), F.max("spare").alias("spare"), F.max("short").alias("short")
    )  # the windows of one item
    kept = by_item.select("item", "short", F.explode(F.expr("slice(seeds, cast(spare + 1 as int), size(seeds))")).alias("s"))
    return kept.select(F.col("s.seed").alias("seed"), "item", "short")


class SeedFilter:
    """A Bloom filter of seeds: one bit in each of four parts of the table."""

    def __init__(self, n_seeds: int):
        import numpy as np

        bits = 1 << 13
        while bits < MOST_FILTER_BITS and bits < FILTER_BITS * n_seeds:
            bits *= 2
        self.mask, self.bits = np.uint64(bits // 4 - 1), np.zeros(bits // 8, np.uint8)

    def places(self, seeds):
        import numpy as np

        part = (int(self.mask) + 1) // 8
        for k in range(4):
            at = (seeds >> np.uint64(16 * k)) * np.uint64(0x9E3779B97F4A7C15 if k else 1) & self.mask
            yield (at >> np.uint64(3)).astype(np.int64) + k * part, np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))

    def add(self, seeds) -> None:
        import numpy as np

        for at, bit in self.places(seeds):
            np.bitwise_or.at(self.bits, at, bit)

    def may_hold(self, seeds):
        import numpy as np

        found = np.ones(len(seeds), bool)
        for at, bit in self.places(seeds):
            found &= self.bits[at] & bit > 0
        return found


def _filter_of(seeds: DataFrame) -> SeedFilter:
    """The filter of all seeds, put together from parts that tasks fill; a part is as large as the whole and comes alone."""
    n = seeds.count()
    empty = SeedFilter(n)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zlib

        own = SeedFilter(n)
        for batch in batches:
            own.add(batch.column(0).to_numpy().view(np.uint64))
        yield pa.record_batch([pa.array([zlib.compress(own.bits.tobytes(), 1)], pa.binary())], names=["bits"])

    import numpy as np
    import zlib

    few = seeds.select("seed").coalesce(max(1, min(8, n // 1_000_000)))
    for row in few.mapInArrow(releasing(fill), "bits binary").toLocalIterator():
        empty.bits |= np.frombuffer(zlib.decompress(bytes(row.bits)), np.uint8)
    return empty


def _pairs(texts: DataFrame, benchmark: DataFrame, threshold: float, min_match: int) -> tuple[DataFrame, DataFrame]:
    """Written candidates (rid, item), and the items (item, item_id, text)."""
    spark = texts.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = written(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = written(item_seeds(items, threshold, min_match), "seeds")
    any_short = not seeds.where("short").isEmpty()
    sent = spark.sparkContext.broadcast(_filter_of(seeds))  # MOST_FILTER_BITS at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bloom = sent.value
        for batch in batches:
            rids, found = [], []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                own = seeds_of(_hashes(words_of(text)), min_match)
                if any_short:
                    lines = {tuple(w) for line in (text or "").split("\n") if 0 < len(w := words_of(line)) < min_match}
                    own = np.concatenate([own, *(seeds_of(_hashes(list(w)), len(w)) for w in lines)])
                own = np.unique(own[bloom.may_hold(own)])
                if len(own):
                    found.append(own.view(np.int64))
                    rids.append(np.full(len(own), rid, np.int64))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(found)), pa.array(np.concatenate(rids))], names=["seed", "rid"])

    # one row for each pair that meets: hot seeds are split by adaptive execution, or meet a broadcast table where items are few
    met = texts.mapInArrow(releasing(emit), "seed long, rid long").join(seeds.select("seed", "item"), "seed")
    return written(met.select("rid", "item").distinct(), "pairs"), items


def _judged(docs: DataFrame, benchmark: DataFrame, threshold: float, min_match: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` read from files, and (rid, doc_id, item_id, item_words, matched_words, n_tiles) of the pairs that reach the threshold."""
    docs, texts = numbered(docs)
    pairs, items = _pairs(texts, benchmark, threshold, min_match)
    asked = pairs.join(items.withColumnRenamed("text", "item_text"), "item").select("rid", F.col("rid").alias("row"), "item_id", "item_text")
    both = beside_texts(texts.withColumnRenamed("doc", "doc_id"), asked, ["row", "item_id", "item_text"], "asked", carry=["doc_id"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "item_id", "item_words", "matched_words", "n_tiles"]
        for batch in batches:
            out = []
            columns = (batch.column(n).to_pylist() for n in ("row", "doc_id", "item_id", "item_text", "text"))
            for row, doc, item_id, item, text in zip(*columns):
                n, words, k = coverage(text or "", item, min_match)
                if words and words >= threshold * n - 1e-9:
                    out.append((row, doc, item_id, n, words, k))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 6)], names=names)

    return docs, both.mapInArrow(releasing(compare), "row long, doc_id long, item_id long, item_words long, matched_words long, n_tiles long")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH) -> DataFrame:
    """One row per document and item whose coverage reaches the threshold."""
    found = _judged(docs, benchmark, threshold, min_match)[1]
    return found.select("doc_id", "item_id", "item_words", "matched_words", "n_tiles", (F.col("matched_words") / F.col("item_words")).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH) -> DataFrame:
    """The documents that cover no item, with their own columns; they are not shuffled."""
    docs, found = _judged(docs, benchmark, threshold, min_match)
    return kept_rows(docs, found.select(F.col("row").alias("rid")).distinct(), drop=True)


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)
