"""Small tables with the awkward cases that every operator has to bear."""

import random

WORDS = "the of and to in is that river stone light garden winter letter copper signal market bridge summer paper window".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) * (r.random() < 0.5) for _ in range(n))


def documents(spark, texts, extra=False):
    """texts: list of (doc_id, text)."""
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'x' AS n_words", "1 AS h", "2 AS class_key", "'p' AS path") if extra else df


AWKWARD = [
    (0, None),
    (1, ""),
    (2, "   \n\t "),
    (3, "a"),
    (4, "x" * 5000),
    (5, "one two  three\n\n\nfour 'tis don't 12,345 été 中文字 \U0001f600 <|endoftext|> end\x1c\x85."),
    (6, "same text for two rows " * 8),
    (7, "same text for two rows " * 8),
    (7, "same text for two rows " * 8),
    (None, "no id here but some words that are long enough to be kept around for a while"),
    (9, "word " * 3000),
]
