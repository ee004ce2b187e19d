"""Quality rules: a table of thresholds compiled into one projection of text ratios.

Only DataFrame functions are used, and no row leaves its task: counts of a text
are computed in place, so there is no shuffle and no skew.

Repeated three-word windows are found by sorting: each window's 64-bit hash loses
its low bits to the window's position (as many bits as the text needs), and one
primitive sort brings equal windows together. Where two neighbours agree in what is
left of their hashes but not in the whole of them, other windows may stand between
equal ones; such a text's windows are sorted again by (whole hash, position). That
is O(n log n) in the words of a text, also for very long ones. Texts without an equal
pair of hashes are not sorted at all; nor are, where the verdict alone is asked for,
those of so few equal ones that the rule of repeated words cannot reject them.

Defined cases: a null or empty text has no words, so all counts are 0, the base
fails and the document is not kept. Repeated rows are judged one by one, an empty
table gives an empty result, and columns other than id and text are not read by the
query. ``with_counts`` passes all columns through; one that has the name of a count
gives way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages, as they stand within a sentence.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "with", "was", "for", "on", "are", "by", "this",
    "der", "die", "das", "und", "ist", "von", "den", "mit", "zu", "im", "auf", "des", "dem",
    "de", "la", "le", "les", "et", "des", "que", "est", "un", "une", "dans", "pour", "qui", "du", "en", "au", "sur",
    "el", "los", "las", "y", "se", "del", "por", "con", "no", "es", "lo", "su", "para", "una", "al",
)
#: (ratio, least, most): a text whose ratio leaves the range is rejected; None leaves that side open.
THRESHOLDS = (
    ("mean_word_chars", 2.0, 12.0),
    ("symbols_per_word", None, 0.1),
    ("stop_word_share", 0.02, None),
    ("duplicate_line_share", None, 0.4),
)
#: Bits of a hash that the first sort leaves out besides those that a position needs.
SPARE_BITS = 0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: A window's first word takes part with the two after it.
WINDOW = 3


def _columns(text: str, exact: bool = True) -> list[dict[str, str]]:
    """The projections, one after another, as SQL expressions over the text column.

    Not ``exact``: ``n_repeat_words`` is 0 where the base cannot fail by it.
    """
    # d windows beyond the first of their kind: at most 2 d windows have an equal one, and 3 words each
    harmless = "d = 0" if exact else f"600L * d <= {MAX_REPEAT_PERCENT}L * size(w)"
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    rank = "cast(length(bin(size(g))) as int)"  # bits that a position needs
    whole = "g[cast(s[{k}] & p as int)]"
    return [
        {
            "w": rf"array_remove(split({text}, '[ \\t-\\r]+'), '')",
            "lines": rf"filter(split({text}, '\\n'), x -> length(trim(BOTH ' \t\u000b\u000c\r' FROM x)) > 0)",
            "n_symbols": rf"cast(length({text}) - length(regexp_replace({text}, '[#*$%&|<>]', '')) as bigint)",
        },
        {
            "n_words": "cast(size(w) as bigint)",
            "word_chars": "cast(length(array_join(w, '')) as bigint)",
            "n_lines": "cast(size(lines) as bigint)",
            "n_dup_lines": "cast(size(lines) - size(array_distinct(lines)) as bigint)",
            "n_stop_words": f"cast(size(filter(w, x -> x IN ({stops}))) as bigint)",
            "all_g": "CASE WHEN size(w) >= 3 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) ELSE array() END",
        },
        {"d": "size(all_g) - size(array_distinct(all_g))"},
        {"g": f"CASE WHEN {harmless} THEN slice(all_g, 1, 0) ELSE all_g END"},
        {"p": f"shiftleft(1L, {rank}) - 1", "m": f"shiftleft(1L, {rank} + {SPARE_BITS}) - 1"},
        {"s": "sort_array(transform(g, (h, i) -> (h & ~m) | cast(i as bigint)))"},
        {"mixed": f"exists(sequence(1, greatest(size(s) - 1, 1)), j -> j < size(s) AND (s[j] & ~m) = (s[j - 1] & ~m) AND {whole.format(k='j')} <> {whole.format(k='j - 1')})"},
        # the windows' hashes and positions in an order in which equal hashes are neighbours
        {"o": "CASE WHEN mixed THEN transform(sort_array(transform(g, (h, i) -> struct(h AS h, i AS i))), x -> x.i) ELSE transform(s, x -> cast(x & p as int)) END"},
        {
            "at": "sort_array(transform(filter(sequence(0, size(o)), j -> j < size(o) AND ("
            "(j > 0 AND g[o[j]] = g[o[j - 1]]) OR (j + 1 < size(o) AND g[o[j]] = g[o[j + 1]]))), j -> o[j]))"
        },
        {"n_repeat_words": "aggregate(transform(at, (x, j) -> IF(j = 0, 3, least(3, x - at[j - 1]))), 0L, (a, x) -> a + x)"},
    ]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def with_counts(docs: DataFrame, text_col: str = "text", exact: bool = True) -> DataFrame:
    """``docs`` plus the counts of each text; helper columns are gone again. Not ``exact``: good for the verdict, see ``_columns``."""
    names = docs.columns
    hidden = {n: f"__in_{i}" for i, n in enumerate(names)}  # the input's columns may have any name
    out = docs.select(*[F.col(f"`{n}`").alias(hidden[n]) for n in names])
    out = out.withColumn("__text", F.coalesce(F.col(hidden[text_col]), F.lit("")))
    for step in _columns("__text", exact):
        out = out.select("*", *[F.expr(v).alias(k) for k, v in step.items()])
    # a generator of one row: without it a later filter on the counts would be pushed down and multiply their expressions
    return out.select(*[F.col(hidden[n]).alias(n) for n in names if n not in COUNTS], F.inline(F.array(F.struct(*COUNTS))))


def verdict(thresholds: Sequence[tuple[str, float | None, float | None]] = THRESHOLDS) -> tuple[Column, Column]:
    """(base_failed, kept) over the counts: the whole table as one boolean expression."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    ratios = {
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "stop_word_share": F.col("n_stop_words") / n,
        "duplicate_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~base_failed
    for name, least, most in thresholds:
        if least is not None:
            kept = kept & (ratios[name] >= least)
        if most is not None:
            kept = kept & (ratios[name] <= most)
    return base_failed, kept


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, ``base_failed`` and ``kept``."""
    base_failed, kept = verdict()
    counted = with_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return counted.select("doc_id", *COUNTS, base_failed.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{n}`").alias(f"c{i}__") for i, n in enumerate(names)])
    counted = with_counts(inner, f"c{names.index(text_col)}__", exact=False)
    return counted.where(verdict()[1]).select(*[F.col(f"c{i}__").alias(n) for i, n in enumerate(names)])


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*RESULT)


def sql(thresholds: Sequence[tuple[str, float | None, float | None]] = THRESHOLDS) -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ratios = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)", "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "stop_word_share": "n_stop / greatest(n_words, 1)", "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    }
    limits = [(name, op, x) for name, least, most in thresholds for op, x in ((">=", least), ("<=", most)) if x is not None]
    rules = " ".join(f"AND {ratios[name]} {op} {x}" for name, op, x in limits)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), t AS (
  SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM t
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c >= 2 GROUP BY rid
), c AS (
  SELECT doc_id, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop
  FROM d LEFT JOIN covered USING (rid)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed {rules} AS kept
FROM b
"""
