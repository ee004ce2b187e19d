import zlib

import numpy as np
from helpers import AWKWARD, documents, prose

from linkloom.llm import discriminant

LABELS = "doc_id long, quality int, toxic int"


def held_out(d):
    return d is None or zlib.crc32(str(d).encode()) % 5 == 0


def corpus(n):
    """Every third document is junk: marks behind each word, capitals, or one word again and again."""
    docs, labels = [], []
    for d in range(n):
        text, bad = prose(30 + 7 * (d % 40), d), d % 3 == 0
        if bad:
            text = [" ".join(w + "###" for w in text.split()), text.upper() + "!!", "again " * (20 + d % 50)][d // 3 % 3]
        docs.append((d, text))
        if d % 4:
            labels.append((d, int(not bad), 0))
    return docs, labels


def plain(docs, labels):
    """Scores by the formula: log-densities with explicit inverses and determinants, rows one by one."""
    x = {k: np.array(discriminant.statistics(t)) for k, (_, t) in enumerate(docs)}
    of = {}
    for d, q, _ in labels:
        if q in (0, 1) and not held_out(d):
            of.setdefault(d, []).append(q)
    weights = [(k, np.mean(of[d])) for k, (d, _) in enumerate(docs) if d in of and not held_out(d)]
    all_x = np.array([x[k] for k, _ in weights])
    centre, scale = all_x.mean(0), all_x.std(0)
    scale[scale < 1e-6] = 1
    z = {k: (v - centre) / scale for k, v in x.items()}
    total, covs, means, n = len(weights), [], [], []
    for c in (0, 1):
        w = np.array([p if c else 1 - p for _, p in weights])
        rows = np.array([z[k] for k, _ in weights])
        means.append((w @ rows) / w.sum())
        covs.append(((rows - means[c]).T * w) @ (rows - means[c]) / w.sum())
        n.append(w.sum())
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / total
    out = []
    for k in range(len(docs)):
        log = []
        for c in (0, 1):
            s = (1 - discriminant.TO_POOLED) * covs[c] + discriminant.TO_POOLED * pooled
            s = (1 - discriminant.TO_DIAGONAL) * s + discriminant.TO_DIAGONAL * np.diag(np.diag(s)) + discriminant.FLOOR * np.eye(len(s))
            v = z[k] - means[c]
            log.append(np.log(n[c] / total) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * v @ np.linalg.inv(s) @ v)
        out.append(1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))))
    return out


def test_scores_follow_the_formula(spark):
    docs, labels = corpus(400)
    docs = docs + [(d, t) for d, t in AWKWARD if d != 9] + docs[:7]
    labels = labels + labels[:20] + [(1, 1, 0), (1, 0, 0), (2, None, 1), (4, 7, 0), (None, 1, 0), (10**6, 1, 0)]
    df = documents(spark, docs, extra=True).repartition(7)
    rows = discriminant.classify(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs)
    want = sorted((-1 if d is None else d, round(s, 6)) for (d, _), s in zip(docs, plain(docs, labels)))
    assert np.allclose([s for _, s in want], [s for _, s in sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 6)) for r in rows)], atol=1e-5)
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.3) for r in rows)


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(1200)
    rows = discriminant.classify(documents(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    late = [r for r in rows if r.held_out]
    assert len(late) > 150 and np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in late]) > 0.97


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(300)
    turned = [(d, 1 - q if held_out(d) else q, 1) for d, q, _ in labels]
    a, b = ({r.doc_id: r.score for r in discriminant.classify(documents(spark, docs), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert a == b


def test_real_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in discriminant.query(spark, sf).collect()}
    late = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(late) > 50 and np.mean([rows[r.doc_id].predicted == r.quality for r in late]) > 0.95


def test_few_labels_and_no_rows(spark):
    docs, labels = corpus(60)
    ones = [(d, 1, 0) for d, q, _ in labels if q]
    none = spark.createDataFrame([], LABELS)
    table = documents(spark, docs)
    assert {r.score for r in discriminant.classify(table, spark.createDataFrame(ones, LABELS)).collect()} == {1.0}
    assert {r.score for r in discriminant.classify(table, none).collect()} == {0.5}
    assert discriminant.classify(table.limit(0), none).count() == 0


def test_long_text_and_filter(spark):
    docs, labels = corpus(300)
    docs.append((5000, prose(1_000_000, 1)))
    table = documents(spark, docs, extra=True)
    kept = discriminant.drop_low(table, spark.createDataFrame(labels, LABELS))
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(ids & {d for d, _ in docs if d % 3}) > 190 and len(ids & {d for d, _ in docs if d % 3 == 0 and d < 300}) < 5
