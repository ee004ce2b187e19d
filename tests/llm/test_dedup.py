import hashlib
import random
from collections import Counter

import numpy as np
from helpers import AWKWARD, documents, prose

from linkloom.llm import jaccard_join, substring_dedup
from linkloom.llm.components import components
from linkloom.llm.shingles import shingle_set


def near_copies(seed=5):
    r = random.Random(seed)
    docs, n = list(AWKWARD), 1000
    for k in range(12):
        words = prose(60 + 20 * k, 100 + k).split()
        for _ in range(r.randrange(1, 9)):
            own = list(words)
            for _ in range(r.randrange(0, 4)):
                own[r.randrange(len(own))] = f"edit{r.randrange(10**6)}"
            docs.append((n, " ".join(own)))
            n += 1
    common = prose(25, 77)
    for k in range(30):
        docs.append((n, prose(30, 300 + k) + " " + common + " " + prose(30, 600 + k)))
        n += 1
    docs += [(n, common), (n + 1, "été " * 40), (n + 2, "été " * 40 + "x")]
    r.shuffle(docs)
    return docs


def brute_classes(docs, threshold=0.8):
    sets = [set(shingle_set((t or "").encode()).tolist()) for _, t in docs]
    parent, links = list(range(len(docs))), [0] * len(docs)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (d, _) in enumerate(docs):
        t = top(k)
        if d is not None and (least.get(t) is None or d < least[t]):
            least[t] = d
        least.setdefault(t, None)
    return sorted((str(d), str(least[top(k)]), links[k]) for k, (d, _) in enumerate(docs))


def result(df):
    return sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in df.collect())


def test_jaccard_join_equals_brute_force(spark):
    docs = near_copies()
    assert result(jaccard_join.jaccard_classes(documents(spark, docs, extra=True).repartition(4))) == brute_classes(docs)


def test_diverse_buckets_are_split_and_large_groups_go_in_blocks(spark, monkeypatch):
    docs = near_copies(6)
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 3)
    original = jaccard_join.candidate_groups
    monkeypatch.setattr(jaccard_join, "candidate_groups", lambda t, m, th, mi: original(t, m, th, mi, leaders=1))
    assert result(jaccard_join.jaccard_classes(documents(spark, docs))) == brute_classes(docs)


def test_keep_one(spark):
    docs = near_copies(7)
    table = documents(spark, docs, extra=True)
    kept = jaccard_join.keep_one(table)
    assert kept.columns == table.columns
    classes = brute_classes(docs)
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted({c for d, c, _ in classes} | {"7"} & {c for _, c, _ in classes})
    assert jaccard_join.keep_one(table.limit(0)).count() == 0
    assert jaccard_join.jaccard_classes(table.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1200)]
    parent = {v: v for e in edges for v in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert {(n.node, n.root) for n in found} == {(v, top(v)) for e in edges if e[0] != e[1] for v in e}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def brute_removals(docs, length=50):
    """Rows in any order; (doc, text) to (bytes, marks)."""
    first = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    rank = lambda d: float("inf") if d is None else d
    for d, b in data:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w not in first or rank(d) < first[w]:
                first[w] = rank(d)
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < rank(d):
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(d), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_kept(docs, length=50):
    """(doc, text that is left); a character that a cut runs through goes whole."""
    rank = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, float("inf")), rank(d))
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < rank(d):
                gone[k : k + length] = True
        yield str(d), bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")


def removal_docs(seed):
    r = random.Random(seed)
    passages = [prose(r.randrange(8, 40), 50 + k) for k in range(8)]
    docs = list(AWKWARD)
    for n in range(60):
        parts = [prose(r.randrange(0, 60), 1000 * seed + n)]
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            a, b = sorted((r.randrange(len(p)), r.randrange(len(p))))
            parts += [p if r.random() < 0.5 else p[a:b], prose(r.randrange(0, 9), 7 * n)]
        docs.append((r.randrange(10, 90), "é".join(parts)))
    docs += [(95, "ab" * 400), (96, "ab" * 90 + "c" + "ab" * 90), (97, "x" * 49), (98, "x" * 50), (99, "ñandú " * 80)]
    r.shuffle(docs)
    return docs


def digest(rows):
    out = []
    for r in rows:
        kept = bytes(r.kept)
        out.append((str(r.doc_id), r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_removals_equal_brute_force(spark):
    for seed in (1, 2):
        docs = removal_docs(seed)
        table = documents(spark, docs, extra=True).repartition(5)
        assert digest(substring_dedup.removals(table).collect()) == brute_removals(docs)


def test_stretches_cover_every_window(monkeypatch):
    monkeypatch.setattr(substring_dedup, "STRETCH", 257)
    docs = removal_docs(3)
    found = [g for g in substring_dedup._stretches(((k, 0, (t or "").encode()) for k, (_, t) in enumerate(docs)), 49)]
    assert max(len(p) for g in found for *_, p in g) <= 257 + 49
    parts = {}
    for g in found:
        for rid, _, at, p in g:
            parts.setdefault(rid, []).append((at, p))
    for k, (_, t) in enumerate(docs):
        data = (t or "").encode()
        starts = {at + i for at, p in parts[k] for i in range(max(0, len(p) - 49))}
        assert starts == set(range(max(0, len(data) - 49)))
        assert all(data[at : at + len(p)] == p for at, p in parts[k])


def test_texts_of_several_stretches(spark):
    """Passages that repeat across the borders of stretches, in texts longer than three of them."""
    r, step = random.Random(8), substring_dedup.STRETCH
    host = [prose(1200, 900 + k) for k in range(110)]
    passage = prose(60, 3)
    long = " ".join(host)
    for k in (1, 2, 3):
        at = k * step - r.randrange(1, 200)
        long = long[:at] + passage + long[at:]
    assert len(long) > 3 * step
    docs = [(1, passage[40:]), (2, long), (3, long[step - 30_000 : step + 30_000] + "tail"), (4, long[: step // 2] + passage)]
    assert digest(substring_dedup.removals(documents(spark, docs)).collect()) == brute_removals(docs)


def test_a_phrase_that_most_documents_share(spark, monkeypatch):
    """The hot rank's rows settle in their lots; one of each lot meets the others (LOT is read where the task is made, so it is as small there)."""
    monkeypatch.setattr(substring_dedup, "LOT", 400)
    phrase = "a line that stands in nearly every document of the table"
    docs = [(k % 150, f"{prose(4, k)} {phrase} {prose(4, 1000 + k % 60)}") for k in range(200)]
    docs += [(500 + k, f"{phrase} {phrase[: 20 + k]}") for k in range(10)] + [(None, phrase)]
    assert digest(substring_dedup.removals(documents(spark, docs).repartition(5)).collect()) == brute_removals(docs)


def test_travellers():
    rank, doc = np.asarray([5, 5, 5, 7, 7, 9], np.uint64), np.asarray([3, 1, 3, 2, 2, 4])
    sent, known = substring_dedup._travellers((rank,), doc)
    assert sent.tolist() == [False, True, False, True, True, True] and known.tolist() == [True, True, True, False, False, False]
    assert all(len(x) == 0 for x in substring_dedup._travellers((rank[:0],), doc[:0]))


def test_remove_repeats_keeps_text_and_columns(spark):
    docs = removal_docs(4)
    table = documents(spark, docs, extra=True)
    rows = substring_dedup.remove_repeats(table)
    assert rows.columns == table.columns
    rows = rows.collect()
    want = sorted(brute_kept(docs))
    assert sorted((str(r.doc_id), r.text or "") for r in rows) == want
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in rows)
    assert sum(r.text is None for r in rows) == sum(t is None for _, t in docs)
    assert substring_dedup.remove_repeats(table.limit(0)).count() == 0
    assert substring_dedup.removals(table.limit(0)).count() == 0


def test_recall_on_a_real_table(spark):
    """Documents whose id is divisible by 20 against all rows of the table, by brute force."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: set(shingle_set((r.text or "").encode()).tolist()) for r in table.collect()}
    where = {}
    for d, own in sets.items():
        for x in own:
            where.setdefault(x, []).append(d)
    got = {r.doc_id: r for r in jaccard_join.jaccard_classes(table).collect()}
    wanted = found = 0
    for q in (d for d in sets if d % 20 == 0):
        both = Counter(d for x in sets[q] for d in where[x] if d != q)
        near = [d for d, n in both.items() if n >= 0.8 * (len(sets[d]) + len(sets[q]) - n) - 1e-9]
        wanted += len(near)
        found += got[q].n_links
        assert all(got[d].class_id == got[q].class_id for d in near)
    assert wanted > 50 and found == wanted


def test_very_long_text(spark):
    text = " ".join(f"{prose(2000, 3)} part{k}" for k in range(120))
    assert len(text) > 1_000_000
    near = text.replace("part7 ", "other7 ")
    docs = documents(spark, [(1, text), (2, near), (3, "short text")])
    assert {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(docs).collect()} == {(1, 1, 1), (2, 1, 1), (3, 3, 0)}
