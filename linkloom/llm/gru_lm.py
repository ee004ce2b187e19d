"""Language-model scores by a gated recurrent network with a class-factored output.

Words are counted over all training documents. The most frequent ones are symbols
of their own, the others share a symbol with the words of the same last bytes, so
p(word) = p(symbol | history) * p(word | symbol), the latter by smoothed counts. The
network is a GRU in numpy; a symbol's probability is that of its class times that
of the symbol in its class.

Texts are encoded once: symbols as 16-bit integers, with what the words' own counts
add to a score. Words are cut, looked up and counted as whole Arrow columns.

Training is by truncated backpropagation through ``WINDOW`` symbols. Every symbol of
every training document is learned from once: each document belongs to one of
``ROUNDS`` passes, and the state is carried from window to window. A document longer
than ``PIECE`` symbols goes in pieces, each with the state that the ``WINDOW`` symbols
before it leave. In a pass documents are dealt to groups by a hash of id and text,
as many groups as the corpus has millions of tokens (``MOST_GROUPS`` at most; then
they grow). Groups train apart from common weights, each in order of id, and are
averaged after the pass in order of group: the model follows from the documents, not
from how they are partitioned. Scoring runs over whole documents; the state is
carried to the end.

Counts of frequent words (``BROADCAST_WORDS`` at most, none longer than
``WORD_BYTES``) are broadcast, those of symbols always; the others' reach the documents
by a join on the word. Longer words have the symbols of their endings.

Defined cases: a null text is empty, its end alone is scored. A null doc_id counts
as the empty text in the fold. Very long texts are encoded, learned from and scored
whole. Repeated rows are scored one by one, and learned from as often. Words of
equal counts are ranked by their bytes where not all become symbols. Without any
training token every word has the same score; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import release, releasing, written

FOLDS, HELD_OUT = 5, 1
SYMBOLS, CLASS = 1024, 32
ENDINGS, ENDING_BYTES = 256, 3
HIDDEN, WINDOW, LANES = 24, 32, 1024
ROUNDS = 2
BATCH, RATE, CLIP = 128, 0.08, 5.0
#: Symbols of a document that one lane learns from one after another.
PIECE = 64 * WINDOW
#: Bound of a logit: far above what training reaches, far below where exp ends.
TOP = 60.0
#: Words whose counts each task holds, and bytes of such a word (29 MB together at most).
BROADCAST_WORDS, WORD_BYTES = 400_000, 64
#: Tokens of a group that trains by itself, and groups of a pass.
GROUP_TOKENS, MOST_GROUPS = 1_000_000, 4096
#: Bytes of texts whose words are looked up together.
SLICE_BYTES = 8_000_000
#: Words of documents that are scored, or learned from, together.
GROUP_WORDS = 2_500_000
#: Averages of weights that come to the driver at once.
SLOTS = 16
END = b"\n"  # no word holds it


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def pass_of(doc_id: Column) -> Column:
    """The pass that learns from the document: one for each id, so no document is in two or in none."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(ROUNDS))


def _keep_memory() -> None:
    """Lets this worker use freed arrays again until the task ends, where giving back each would take a third of the time."""
    import ctypes

    try:
        mallopt = ctypes.CDLL(None).mallopt
    except AttributeError:  # not with this C library
        return
    for option in (-3, -1):  # arrays under 32 MB come from the heap, whose free end stays up to so much
        mallopt(option, 32 << 20)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with a bounded number of bytes in a text column (or one row)."""
    import numpy as np

    ends = np.cumsum([0, *(len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(column))])
    at = 0
    while at < batch.num_rows:
        last = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, last - at)
        at = last


def _words(texts: pa.Array):
    """All words of an Arrow column of strings, A-Z in lower case, as one binary column, and the row of each."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # at just the six characters
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real).cast(pa.binary()), rows.filter(real).to_numpy()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c) over all tokens of the given documents, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held, ends = [], 0

        def together() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for batch in batches:
            ends += batch.num_rows
            for part in _slices(batch, 0):
                found = pc.value_counts(_words(part.column(0))[0])
                held.append(pa.table([found.field(0), found.field(1)], names=["word", "c"]))
                if sum(map(len, held)) > 800_000:
                    held = [together()]
                    if len(held[0]) > 400_000:
                        yield from held[0].combine_chunks().to_batches()
                        held = []
        if ends:
            held.append(pa.table([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "c"]))
            yield from together().combine_chunks().to_batches()

    return docs.select("text").mapInArrow(releasing(count), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int = BROADCAST_WORDS) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts, at most so many, the most frequent first.

    A histogram of counts (sixteen bins for each doubling) says from which count on;
    only words above come to the driver. Words of one bin come together or not at all,
    but for those that become symbols: these always come, however many share a bin.
    """
    counts = counts.where(F.octet_length("word") <= WORD_BYTES)
    symbols = SYMBOLS - ENDINGS  # the end, if it is among them, takes no word's place
    bin_of = F.floor(16 * F.log2("c")).cast("int")
    bins = counts.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n")).collect()  # a thousand rows at most
    total, least = 0, None
    for r in sorted(bins, key=lambda r: -r.b):
        total += r.n
        if total > most:
            break
        least = r.b
    found = {}
    if least is not None:
        rows = counts.where(bin_of >= least).select("word", "c").toArrow()  # ``most`` rows of WORD_BYTES at most
        found = dict(zip(rows["word"].to_pylist(), rows["c"].to_pylist()))
    if total > most and len(found) < symbols:
        found |= {bytes(r.word): r.c for r in counts.orderBy(F.desc("c"), "word").limit(symbols).collect()}
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """Symbols: 0 is the end, then frequent words, then endings, the last of which is any other."""

    def __init__(self, words: list[tuple[bytes, int]], endings: list[tuple[bytes, int, int]], other: tuple[int, int], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        first = 1 + len(words)
        self.word = {w: k for k, (w, _) in enumerate(words, 1)}
        self.ending = {e: first + k for k, (e, _, _) in enumerate(endings)}
        self.other = first + len(endings)
        self.size = self.other + 1
        mass = [n for _, n, _ in endings] + [other[0]]
        kinds = [v for _, _, v in endings] + [other[1]]
        self.first_ending = first
        #: log10 of what (c + 0.5) is divided by, for words of each ending
        self.divisor = [math.log10(n + 0.5 * (v + 1)) for n, v in zip(mass, kinds)]
        ends = total - sum(n for _, n in words) - sum(mass)
        self.counts = [max(ends, 0), *(n for _, n in words), *mass]

    def symbol(self, word: bytes) -> int:
        return self.word.get(word) or self.ending.get(word[-ENDING_BYTES:], self.other)


class Lookup:
    """Known words as columns: symbol, logarithm of the count; and the symbols of endings for all others."""

    def __init__(self, vocab: Vocabulary, words: pa.Array, counts):
        import numpy as np

        self.vocab, self.words = vocab, words
        self.symbol = np.fromiter(map(vocab.symbol, words.to_pylist()), np.int16, len(words))
        self.logs = np.log10(counts + 0.5)
        self.endings = pa.array(list(vocab.ending), pa.binary())
        self.ending_symbol = np.asarray([*vocab.ending.values(), vocab.other], np.int16)
        #: What log10 of an ending's probability is less, by symbol.
        self.divisors = np.asarray([0.0] * vocab.first_ending + vocab.divisor)

    def of(self, words: pa.Array):
        """(symbol, logarithm of the count or 0, whether the word is known) of each word."""
        import numpy as np
        import pyarrow.compute as pc

        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        known = at >= 0
        symbol, logs = np.empty(len(at), np.int16), np.zeros(len(at))
        symbol[known], logs[known] = self.symbol[at[known]], self.logs[at[known]]
        rare = words.filter(pa.array(~known))
        ends = pc.fill_null(pc.index_in(pc.binary_slice(rare, -ENDING_BYTES), value_set=self.endings), len(self.endings)).to_numpy()
        symbol[~known] = self.ending_symbol[ends]
        return symbol, logs, known


class Network:
    """The GRU's weights and its passes. A symbol's input row holds its share of all three gates."""

    NAMES = ("inputs", "states", "classes", "class_bias", "outputs", "output_bias")

    def __init__(self, counts: list[int] | None = None, weights: dict | None = None):
        import numpy as np

        if weights is not None:
            self.w = weights
            return
        r, h, n_class = np.random.default_rng(7), HIDDEN, SYMBOLS // CLASS
        mass = np.full(SYMBOLS, 1e-3)
        mass[: len(counts)] += counts
        log = np.log(mass / mass.sum())
        by_class = log.reshape(n_class, CLASS)
        class_log = np.log(np.exp(by_class).sum(1))
        f = lambda *s: r.normal(0, 1, s).astype(np.float32)
        self.w = {
            "inputs": 0.1 * f(SYMBOLS, 3 * h),
            "states": f(h, 3 * h) / np.float32(math.sqrt(h)),
            "classes": 0.02 * f(h, n_class),
            "class_bias": class_log.astype(np.float32),
            "outputs": 0.02 * f(n_class, h, CLASS),
            "output_bias": (by_class - class_log[:, None]).astype(np.float32),
        }

    def steps(self, symbols, begins, state, keep: list | None = None):
        """States after each input; ``begins`` marks inputs before which the state is cleared. Both are (lanes, time)."""
        import numpy as np

        h, w = HIDDEN, self.w
        # lanes stand last within, so that each gate is one stretch of memory
        x = np.ascontiguousarray(w["inputs"][symbols.T].swapaxes(1, 2))
        turned, state = np.ascontiguousarray(w["states"].T), np.ascontiguousarray(state.T)
        out, cleared = np.empty((len(x), h, len(symbols)), x.dtype), begins.any(0)
        for t in range(len(x)):
            if cleared[t]:
                state = state * ~begins[:, t]
            q = turned @ state
            gates = x[t, : 2 * h] + q[: 2 * h]
            np.exp(np.negative(gates, out=gates), out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:h], gates[h:]
            n = r * q[2 * h :]
            n += x[t, 2 * h :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((state, z, r, n, q[2 * h :]))
            after = np.subtract(state, n, out=out[t])
            after *= z
            after += n
            state = after
        return out.swapaxes(1, 2), state.T

    def log_probabilities(self, states, targets, gradient: bool = False):
        """Natural log of each target; with ``gradient``, also what training needs."""
        import numpy as np

        w = self.w
        # targets by class, and a last column of ones by which biases are weights like others
        order = np.argsort((targets // CLASS).astype(np.int16), kind="stable")
        sorted_, rows = targets.take(order), np.arange(len(targets))
        c, k = sorted_ // CLASS, sorted_ % CLASS
        hs = np.ones((len(targets), HIDDEN + 1), states.dtype)
        hs[:, :-1] = states.take(order, 0)
        # bounded instead of shifted by their maximum, and summed by a product: rows are short
        logits = hs @ np.concatenate([w["classes"], w["class_bias"][None]])
        np.exp(np.minimum(logits, TOP, out=logits), out=logits)
        total = logits @ np.ones(logits.shape[1], logits.dtype)
        edges = np.searchsorted(c, np.arange(SYMBOLS // CLASS + 1)).tolist()
        own = [(j, slice(lo, hi)) for j, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if lo < hi]
        within = np.concatenate([w["outputs"], w["output_bias"][:, None]], 1)
        y = np.empty((len(c), CLASS), np.result_type(hs, within))
        for j, at in own:
            np.matmul(hs[at], within[j], out=y[at])
        np.exp(np.minimum(y, TOP, out=y), out=y)
        total_within = y @ np.ones(CLASS, y.dtype)
        at_class, at_symbol = rows * logits.shape[1] + c, rows * CLASS + k
        out = np.empty(len(c), y.dtype)
        out[order] = np.log(logits.take(at_class) / total) + np.log(y.take(at_symbol) / total_within)
        if not gradient:
            return out
        logits *= (1 / total)[:, None]
        logits.reshape(-1)[at_class] -= 1
        y *= (1 / total_within)[:, None]
        y.reshape(-1)[at_symbol] -= 1
        sums, inner = hs.T @ logits, np.zeros_like(within)
        pulled = logits @ w["classes"].T
        for j, at in own:
            np.matmul(hs[at].T, y[at], out=inner[j])
            pulled[at] += y[at] @ w["outputs"][j].T
        back = np.empty_like(pulled)
        back[order] = pulled
        return out, {"classes": sums[:-1], "class_bias": sums[-1], "outputs": inner[:, :-1], "output_bias": inner[:, -1]}, back

    def gradients(self, before, fresh, window, real):
        """Of the summed loss of windows (lanes, time + 1); ``before`` (lanes, time) leaves their states.

        ``fresh`` marks lanes that begin a document, ``real`` the targets (lanes, time) that count.
        """
        import numpy as np

        no = np.zeros(real.shape, bool)
        _, state = self.steps(before, no, np.zeros((len(window), HIDDEN), np.float32))
        return self.carried(window[:, :-1], window[:, 1:], no, real, state * ~fresh[:, None])[0]

    def carried(self, inputs, targets, begins, real, state):
        """Gradients of the summed loss of lanes that ``state`` precedes, and the states they end in.

        All but ``state`` are (lanes, time); ``begins`` marks inputs before which the state is cleared.
        """
        import numpy as np

        h = HIDDEN
        kept: list = []
        counted, cleared = np.flatnonzero(real.T), begins.any(0)
        states, after = self.steps(inputs, begins, state, kept)
        _, grads, got = self.log_probabilities(states.reshape(-1, h).take(counted, 0), targets.T.reshape(-1).take(counted), gradient=True)
        back = np.zeros((real.size, h), got.dtype)
        back[counted] = got
        back = np.ascontiguousarray(back.reshape(states.shape).swapaxes(1, 2))
        # of the gates before their functions: by way of the inputs, and by way of the states
        pushed = np.empty((len(back), 3 * h, len(inputs)), back.dtype)
        pulled = np.empty_like(pushed)
        ahead = np.zeros_like(back[0])
        for t in range(len(back) - 1, -1, -1):
            s, z, r, n, q = kept[t]
            dz, dr, dn, dq = pushed[t, :h], pushed[t, h : 2 * h], pushed[t, 2 * h :], pulled[t]
            d = back[t]
            d += ahead
            on = d * z
            np.subtract(1, np.multiply(n, n, out=dn), out=dn)
            d -= on
            dn *= d
            np.subtract(s, n, out=dz)
            dz *= on
            dz *= 1 - z
            np.multiply(dn, r, out=dq[2 * h :])
            np.multiply(dq[2 * h :], q, out=dr)
            dr *= 1 - r
            dq[: 2 * h] = pushed[t, : 2 * h]
            ahead = self.w["states"] @ dq
            ahead += on
            if cleared[t]:
                ahead *= ~begins[:, t]
        grads["states"] = (np.stack([x[0] for x in kept]) @ pulled.swapaxes(1, 2)).sum(0)
        grads["inputs"] = _summed(pushed.swapaxes(1, 2).reshape(-1, 3 * h), inputs.T.reshape(-1), np.zeros_like(self.w["inputs"]))
        return grads, after


def _summed(rows, symbols, out):
    """Adds to each symbol's row of ``out``, which has none yet, the rows that are its own."""
    import numpy as np

    order = np.argsort(symbols.astype(np.int16), kind="stable")
    rows, symbols = rows.take(order, 0), symbols[order]
    first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    times = np.diff(np.append(first, len(symbols)))
    few = 8  # rarer symbols all at once: their first rows, their second ones, and so on
    for lo, n in zip(first[times > few].tolist(), times[times > few].tolist()):
        out[symbols[lo]] = np.ones(n, rows.dtype) @ rows[lo : lo + n]
    first, times = first[times <= few], times[times <= few]
    for k in range(few):
        at = first[times > k] + k
        out[symbols[at]] += rows.take(at, 0)
    return out


def _dealt(sizes: list[int], lanes: int) -> list[list[int]]:
    """Which documents each lane holds one after another, so that lanes are about equally long."""
    load = [(0, k) for k in range(lanes)]
    streams: list[list[int]] = [[] for _ in range(lanes)]
    for d in sorted(range(len(sizes)), key=lambda d: -sizes[d]):
        n, k = heapq.heappop(load)
        streams[k].append(d)
        heapq.heappush(load, (n + sizes[d], k))
    return streams


class Trainer:
    """Adagrad on batches of ``BATCH`` lanes by ``WINDOW`` symbols, with the norm of a batch's gradient bounded."""

    def __init__(self, net: Network):
        import numpy as np

        self.net, self.seen, self.pieces, self.held = net, 0, [], 0
        self.squares = {k: np.full_like(v, 1e-4) for k, v in net.w.items()}

    def add(self, ids) -> None:
        """A document's symbols, its end included: each is a target once."""
        import numpy as np

        sequence = np.concatenate([np.zeros(1, np.int16), ids])
        for at in range(0, len(ids), PIECE):
            before = min(at, WINDOW)  # inputs that only lead to the piece's first state
            self.pieces.append((sequence[at - before : at + PIECE + 1], before))
            self.held += len(self.pieces[-1][0])
        if self.held >= GROUP_WORDS:
            self.learn()

    def learn(self) -> None:
        """Learns from all pieces held; lanes hold one after another."""
        import numpy as np

        pieces, self.pieces, self.held = self.pieces, [], 0
        if not pieces:
            return
        sizes = [len(p) - 1 for p, _ in pieces]
        lanes = min(BATCH, len(pieces))
        streams = [sorted(own) for own in _dealt(sizes, lanes)]  # in the order in which they came
        streams.sort(key=lambda own: -sum(sizes[d] for d in own))
        ends = np.asarray([sum(sizes[d] for d in own) for own in streams])
        inputs, targets = (np.zeros((lanes, int(ends[0])), np.int16) for _ in range(2))
        begins, real = (np.zeros(inputs.shape, bool) for _ in range(2))
        for k, own in enumerate(streams):
            at = 0
            for d in own:
                sequence, before = pieces[d]
                end = at + sizes[d]
                inputs[k, at:end], targets[k, at:end] = sequence[:-1], sequence[1:]
                begins[k, at], real[k, at + before : end] = True, True
                at = end
        state = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, inputs.shape[1], WINDOW):
            live = int((ends > at).sum())  # lanes end one after another, the last first
            cut = (slice(live), slice(at, at + WINDOW))
            n = int(real[cut].sum())
            if n:
                grads, state = self.net.carried(inputs[cut], targets[cut], begins[cut], real[cut], state[:live])
                self.update(grads, n)
            else:
                _, state = self.net.steps(inputs[cut], begins[cut], state[:live])

    def update(self, total: dict, n: int) -> None:
        """One step by the gradients of ``n`` targets."""
        import numpy as np

        norm = math.sqrt(sum(float((v * v).sum()) for v in total.values())) / n
        scale = min(1.0, CLIP / max(norm, 1e-9)) / n
        for k, v in total.items():
            v = v * np.float32(scale)
            self.squares[k] += v * v
            self.net.w[k] -= np.float32(RATE) * v / np.sqrt(self.squares[k])
        self.seen += n


ENCODED = "row long, word binary, times long, doc_id long, held_out boolean, turn int, h long, n_tokens long, n_known long, log_counts double, extra double, ids binary"


def encode(docs: DataFrame, training: Column, vocab: Vocabulary, known: list[tuple[bytes, int]], ends: int) -> DataFrame:
    """Written rows of ENCODED: one per document, with its symbols, and one for each word in it whose count is not broadcast.

    ``ends`` is the count of ends in training texts.
    """
    import numpy as np

    spark = docs.sparkSession
    words = [(w, c) for w, c in known if w != END]
    columns = pa.array([w for w, _ in words], pa.binary()), np.asarray([c for _, c in words], np.int64)
    sent = spark.sparkContext.broadcast((vocab, *columns))  # BROADCAST_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(*sent.value)
        first, part, nth = lookup.vocab.first_ending, TaskContext.get().partitionId(), 0
        names = [c.split()[0] for c in ENCODED.split(", ")]
        end_log = math.log10(ends + 0.5)
        for batch in batches:
            for own in _slices(batch, 4):
                n = own.num_rows
                rows = (part << 36) + nth + np.arange(n)
                nth += n
                words, row = _words(own.column(4))
                symbol, logs, found = lookup.of(words)
                count = np.bincount(row, minlength=n)
                total = lambda x: np.bincount(row, x, n).astype(np.float64)  # noqa: E731  (of no rows it counts)
                # what the word's own probability under its ending holds of the score
                extra = total(np.where(symbol >= first, logs, 0) - lookup.divisors[symbol])
                sequence = np.zeros(len(symbol) + n, np.int16)
                sequence[np.arange(len(symbol)) + row] = symbol
                offsets = np.concatenate([[0], np.cumsum(2 * (count + 1))]).astype(np.int64)
                ids = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(sequence.tobytes())]).cast(pa.binary())
                whole = {
                    "row": pa.array(rows), "word": pa.nulls(n, pa.binary()), "times": pa.nulls(n, pa.int64()), "doc_id": own.column(0), "held_out": own.column(1), "turn": own.column(2), "h": own.column(3),
                    "n_tokens": pa.array(count + 1), "n_known": pa.array(total(found).astype(np.int64) + int(ends > 0)), "log_counts": pa.array(total(logs) + end_log), "extra": pa.array(extra), "ids": ids,
                }
                yield pa.record_batch([whole[c] for c in names], names=names)
                rare = words.filter(pa.array(~found)).dictionary_encode()
                if len(rare):
                    code = rare.indices.to_numpy().astype(np.int64)
                    pair, times = np.unique(row[~found].astype(np.int64) * len(rare.dictionary) + code, return_counts=True)
                    m = len(pair)
                    few = {"row": pa.array(rows[pair // len(rare.dictionary)]), "word": rare.dictionary.take(pa.array(pair % len(rare.dictionary))), "times": pa.array(times.astype(np.int64))}
                    yield pa.record_batch([few.get(c, pa.nulls(m, whole[c].type)) for c in names], names=names)

    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("doc_id"), (~training).alias("held_out"), pass_of(doc).cast("int").alias("turn"), F.xxhash64("doc_id", "text").alias("h"), "text")
    return written(rows.mapInArrow(releasing(run), ENCODED), "encoded", "lz4")


def _train(encoded: DataFrame, weights: dict, turn: int, groups: int) -> dict:
    """One pass over the training documents that belong to it; the weights averaged over its groups."""
    import numpy as np

    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast(weights)  # fewer than a million numbers

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        now, trainer = None, None

        def finished():
            trainer.learn()
            blob = pickle.dumps({k: v * np.float64(trainer.seen) for k, v in trainer.net.w.items()})
            return pa.record_batch([pa.array([now % SLOTS], pa.int32()), pa.array([now], pa.int32()), pa.array([trainer.seen], pa.int64()), pa.array([blob], pa.binary())], names=["slot", "grp", "seen", "blob"])

        for batch in batches:
            for grp, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if grp != now:
                    if trainer is not None:
                        yield finished()
                    now, trainer = grp, Trainer(Network(weights={k: v.copy() for k, v in sent.value.items()}))
                trainer.add(np.frombuffer(ids.as_buffer(), np.int16))
        if trainer is not None:
            yield finished()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for slot, n, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                part = pickle.loads(blob.as_py())
                had = totals.get(slot)
                totals[slot] = [n, part] if had is None else [had[0] + n, {k: had[1][k] + v for k, v in part.items()}]
        for slot, (n, total) in totals.items():
            yield pa.record_batch([pa.array([slot], pa.int32()), pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([pickle.dumps(total)], pa.binary())], names=["slot", "grp", "seen", "blob"])

    schema = "slot int, grp int, seen long, blob binary"
    rows = encoded.where((F.col("turn") == turn) & F.col("word").isNull() & ~F.col("held_out"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.pmod("h", F.lit(groups)).cast("int").alias("grp"), "doc_id", "h", "ids").repartition(n, "grp").sortWithinPartitions("grp", "doc_id", "h").select("grp", "ids")
    parts = dealt.mapInArrow(releasing(learn), schema).repartition(SLOTS, "slot").sortWithinPartitions("slot", "grp").mapInArrow(releasing(add_up), schema)
    parts = sorted(parts.collect(), key=lambda p: p.slot)  # SLOTS rows
    seen = sum(p.seen for p in parts)
    if not seen:
        return weights
    sums = [pickle.loads(p.blob) for p in parts]
    return {k: (sum(s[k] for s in sums) / seen).astype(np.float32) for k in Network.NAMES}


def vocabulary(counts: DataFrame, known: list[tuple[bytes, int]]) -> Vocabulary:
    """Symbols from the word counts of the training documents and their most frequent words."""
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    words = [x for x in known if x[0] != END][: SYMBOLS - 1 - ENDINGS]
    spark = counts.sparkSession
    own = spark.createDataFrame([(w,) for w, _ in [*words, (END, 0)]], "word binary")
    rest = counts.join(F.broadcast(own), "word", "left_anti")  # fewer than SYMBOLS rows
    by_end = rest.groupBy(F.expr(f"substring(word, -{ENDING_BYTES}, {ENDING_BYTES})").alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    by_end = written(by_end, "endings")
    ends = by_end.orderBy(F.desc("n"), "e").limit(ENDINGS - 1).collect()
    n, v = by_end.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    release(by_end)
    endings = [(bytes(r.e), r.n, r.v) for r in ends]
    other = (n - sum(x[1] for x in endings), v - sum(x[2] for x in endings))
    return Vocabulary(words, endings, other, total or 0, distinct)


def train(encoded: DataFrame, vocab: Vocabulary) -> dict:
    """Weights from the encoded training documents."""
    weights = Network(vocab.counts).w
    groups = max(1, min(MOST_GROUPS, -(-vocab.total // (ROUNDS * GROUP_TOKENS))))
    for turn in range(ROUNDS):
        weights = _train(encoded, weights, turn, groups)
    return weights


def fit(training: DataFrame, counts: DataFrame, known: list[tuple[bytes, int]]) -> tuple[Vocabulary, dict]:
    """Vocabulary and weights from training documents, their word counts and the most frequent words."""
    vocab = vocabulary(counts, known)
    encoded = encode(training, F.lit(True), vocab, known, training.count())
    weights = train(encoded, vocab)
    release(encoded)
    return vocab, weights


def _document_logs(net: Network, docs: list):
    """Natural log probability of each document's symbols; lanes hold one document after another."""
    import numpy as np

    out = np.zeros(len(docs))
    longest, total = max(map(len, docs)), sum(map(len, docs))
    lanes = max(1, min(LANES, -(-total // longest), len(docs)))
    streams = _dealt([len(d) for d in docs], lanes)
    time = max(sum(len(docs[d]) for d in own) for own in streams)
    symbols, owner, begins = np.zeros((lanes, time), np.int16), np.full((lanes, time), -1, np.int32), np.zeros((lanes, time), bool)
    for k, own in enumerate(streams):
        at = 0
        for d in own:
            symbols[k, at : at + len(docs[d])] = docs[d]
            owner[k, at : at + len(docs[d])] = d
            begins[k, at] = True
            at += len(docs[d])
    inputs = np.zeros_like(symbols)
    inputs[:, 1:] = symbols[:, :-1]
    inputs[begins] = 0
    state = np.zeros((lanes, HIDDEN), np.float32)
    for at in range(0, time, WINDOW):
        cut = slice(at, at + WINDOW)
        live = owner[:, at] >= 0  # lanes end one after another
        states, state[live] = net.steps(inputs[live, cut], begins[live, cut], state[live])
        who = owner[live, cut].T.reshape(-1)
        real = who >= 0
        logs = net.log_probabilities(states.reshape(-1, HIDDEN)[real], symbols[live, cut].T.reshape(-1)[real].astype(np.int64))
        out += np.bincount(who[real], logs, len(docs))
    return out


def scores(docs: DataFrame, training: Column) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` says of each row whether the model learns from it.
    """
    taught = docs.where(training)
    counts = written(word_counts(taught), "counts")
    known = frequent_words(counts)
    vocab = vocabulary(counts, known)
    ends = [r.c for r in counts.where(F.col("word") == F.lit(END)).collect()]
    encoded = encode(docs, training, vocab, known, sum(ends))
    sent = docs.sparkSession.sparkContext.broadcast(train(encoded, vocab))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        _keep_memory()
        net, group, held = Network(weights=sent.value), [], 0

        def flush():
            rows = pa.Table.from_batches([g for g, _ in group])
            model = _document_logs(net, [ids for _, own in group for ids in own]) / math.log(10)
            model += rows["extra"].to_numpy()
            return rows.drop_columns(["ids", "extra"]).append_column("model", pa.array(model)).combine_chunks().to_batches()

        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), np.int16) for x in batch.column(batch.schema.get_field_index("ids"))]
            at = 0
            while at < len(ids):
                last, own = at, 0
                while last < len(ids) and held + own < GROUP_WORDS:
                    own += len(ids[last])
                    last += 1
                group.append((batch.slice(at, last - at), ids[at:last]))
                held += own
                if held >= GROUP_WORDS:
                    yield from flush()
                    group, held = [], 0
                at = last
        if group:
            yield from flush()

    slim = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double"
    documents = encoded.where("word is null").select(*[c.split()[0] for c in slim.split(", ")], "extra", "ids")
    scored = documents.mapInArrow(releasing(score), f"{slim}, model double")
    rare = encoded.where("word is not null").select("row", "word", "times").join(counts, "word", "left")
    # every rare word has a symbol of an ending, so its count's logarithm belongs to both scores
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"),
    )
    whole = scored.join(rare, "row", "left")
    divisor = math.log10(vocab.total + 0.5 * (vocab.distinct + 1))
    logs = F.coalesce("logs", F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * divisor).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scores(docs, ~held_out(F.col("doc_id")))
