"""Quality classifier: a regularised quadratic discriminant over statistics of each text.

A text becomes a row of transformed statistics (shares, logarithms). The classes'
means and covariances come from sums of x and of its products over all labelled
training rows: each task sums its own rows, so what meets is one row of numbers per
task and class, however large the corpus and however unequal the labels. A class
covariance is shrunk towards the pooled one, and that towards its diagonal; its
Cholesky factor and log-determinant are computed once and go to the tasks as a few
hundred numbers. The score is the posterior of label 1: the difference of the two
log-densities (half the Mahalanobis distances by solving with the cached factors)
plus that of the log priors, through the logistic function.

Defined cases: a null text counts as empty, an empty one has the statistics of no
words and is scored like any other. Labels, lang, source and doc_id do not enter a
score; doc_id only says which rows may teach. A null or unlabelled doc_id teaches
nothing; several labels of one doc_id share its weight, rows that repeat a doc_id
count each. Labels other than 0 and 1 are left out. Without training rows of both
classes every score is the share of label 1 among them (no rows: one half). Very long
texts are counted in one pass and need a few copies of themselves. Empty tables give
empty results, and other columns of the documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import release, releasing, written

#: Of every so many residues of crc32(doc_id) the first is held out.
FOLDS = 5
THRESHOLD = 0.3
#: How far a class covariance goes to the pooled one, and the result to its diagonal.
TO_POOLED, TO_DIAGONAL = 0.3, 0.05
#: Added to each variance of the standardised statistics, so that constant ones have a factor too.
FLOOR = 1e-3

FEATURES = (
    "log_words", "mean_word_bytes", "upper_share", "digit_share", "mark_share", "stop_share", "other_ascii_share", "space_share",
    "line_share", "distinct_words", "repeated_neighbours", "short_words", "capital_words", "marked_words", "distinct_lines",
)
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
_DIGITS = b"0123456789"
_MARKS = b"#*$%&|<>!@^~_=+"
_STOPS = b".,;:?"
_SPACES = b" \t\n\x0b\x0c\r"
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """FEATURES of one text."""
    raw = (text or "").encode("utf-8", "replace")
    size = max(len(raw), 1)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    words = raw.split()
    n = max(len(words), 1)
    upper, digits, marks, stops = share(_UPPER), share(_DIGITS), share(_MARKS), share(_STOPS)
    spaces, lines = share(_SPACES), raw.split(b"\n")
    letters = share(_LOWER) + share(_HIGH)
    return [
        np.log1p(len(words)),
        np.log1p(sum(map(len, words)) / n),
        np.sqrt(upper),
        np.sqrt(digits),
        np.sqrt(marks),
        np.sqrt(stops),
        np.sqrt(max(0.0, 1 - upper - digits - marks - stops - spaces - letters)) if raw else 0.0,
        spaces,
        np.sqrt(len(lines) / n),
        len(set(words)) / n,
        np.sqrt(sum(map(bytes.__eq__, words, words[1:])) / n),
        sum(len(w) <= 3 for w in words) / n,
        np.sqrt(sum(w[:1] in _CAPITAL for w in words) / n),
        np.sqrt(sum(w[-1:] in _MARKED for w in words) / n),
        len(set(lines)) / len(lines),
    ]


_CAPITAL = frozenset(bytes([c]) for c in _UPPER)
_MARKED = frozenset(bytes([c]) for c in _MARKS)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): each row's statistics."""
    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return kept.mapInArrow(releasing(_measured), "doc_id long, x array<double>")


def is_held_out(doc_id: Column) -> Column:
    """Whether a document teaches nothing; a null doc_id belongs to neither side and teaches nothing either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


@dataclass
class Moments:
    """Of one class: weight of its rows, sum of x, sum of the products x x'."""

    weight: float
    first: np.ndarray
    second: np.ndarray


def moments(x: DataFrame, labels: DataFrame, label: str = "quality") -> dict[int, Moments]:
    """Sums over all rows of ``x`` that teach, by class. Tasks add up their own rows; a few numbers for each meet."""
    asked = labels.where(F.col(label).isin(0, 1)).where(~is_held_out(F.col("doc_id")))
    shares = asked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("one"))
    rows = x.where(~is_held_out(F.col("doc_id"))).join(shares, "doc_id").select("x", "one")
    d = len(FEATURES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.asarray(batch.column(0).flatten()).reshape(-1, d)
            one = np.asarray(batch.column(1))
            for k, w in enumerate((1 - one, one)):
                total[k] += np.concatenate([[w.sum()], w @ values, ((values * w[:, None]).T @ values).ravel()])
        names = ["class", "at", "value"]
        n = total.shape[1]
        yield pa.record_batch([pa.array(np.repeat([0, 1], n), pa.int32()), pa.array(np.tile(np.arange(n), 2), pa.int32()), pa.array(total.ravel())], names=names)

    sums = rows.mapInArrow(releasing(add), "class int, at int, value double").groupBy("class", "at").agg(F.sum("value").alias("value"))
    found = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in sums.collect():  # two classes of 1 + d + d * d numbers, whatever the input
        found[r["class"]][r["at"]] = r["value"]
    return {k: Moments(v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in found.items()}


@dataclass
class Discriminant:
    """What the tasks need: scaling, and per class mean, inverse Cholesky factor and constant; or one score for all."""

    constant: float | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple = ()
    factors: tuple = ()
    offsets: tuple = ()

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        log = [c - 0.5 * np.square((z - m) @ f.T).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(sums: dict[int, Moments], to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """Means, shrunk covariances and their factors from the sums of both classes."""
    n = sums[0].weight + sums[1].weight
    if min(sums[0].weight, sums[1].weight) <= 0:
        return Discriminant(constant=0.5 if n <= 0 else float(sums[1].weight / n))
    centre = (sums[0].first + sums[1].first) / n
    spread = np.diag(sums[0].second + sums[1].second) / n - centre**2
    # a statistic without spread tells nothing and is left at its centre
    scale = np.where(spread > 1e-12, np.sqrt(np.maximum(spread, 1e-12)), 1.0)
    means, own = [], []
    for k in (0, 1):
        mean = sums[k].first / sums[k].weight
        cov = sums[k].second / sums[k].weight - np.outer(mean, mean)
        means.append((mean - centre) / scale)
        own.append(cov / np.outer(scale, scale))
    pooled = sum(sums[k].weight * own[k] for k in (0, 1)) / n
    factors, offsets = [], []
    for k in (0, 1):
        cov = (1 - to_pooled) * own[k] + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + FLOOR * np.eye(len(cov))
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.solve(lower, np.eye(len(cov))))
        offsets.append(float(np.log(sums[k].weight / n) - np.log(np.diag(lower)).sum()))
    return Discriminant(None, centre, scale, tuple(means), tuple(factors), tuple(offsets))


def scored(x: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of measured rows."""
    d = len(FEATURES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(1).flatten(), dtype=float).reshape(-1, d)
            yield pa.record_batch([batch.column(0), pa.array(model.scores(values))], names=["doc_id", "score"])

    rows = x.select("doc_id", "x").mapInArrow(score, "doc_id long, score double")
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row per document. Texts are read once: their statistics are written, learned from and scored."""
    x = written(measured(docs), "statistics")
    return scored(x, fit(moments(x, labels, label)))


def drop_low(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with their own columns; the rest of the table is not shuffled."""
    x = written(measured(docs), "statistics")
    model = fit(moments(x, labels))
    release(x)
    names = docs.columns
    at = names.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t.as_py()) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(values) >= threshold))

    inner = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return inner.mapInArrow(releasing(choose), kinds).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
