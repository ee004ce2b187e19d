import random

from helpers import AWKWARD, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import decontaminate as d


def greedy_tiles(text, item, least):
    """Brute force: the longest unmarked common run, again and again; the first in the text, then in the item, of equal ones."""
    free_t, free_i, out = [True] * len(text), [True] * len(item), []
    while True:
        best = 0
        for t in range(len(text)):
            for i in range(len(item)):
                n = 0
                while t + n < len(text) and i + n < len(item) and free_t[t + n] and free_i[i + n] and text[t + n] == item[i + n]:
                    n += 1
                if n > best:
                    best, at = n, (t, i)
        if best < least:
            return out
        out.append((*at, best))
        for k in range(best):
            free_t[at[0] + k] = free_i[at[1] + k] = False


def greedy(text, item, least):
    return sum(n for _, _, n in greedy_tiles(text, item, least))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=25))
def test_tiles_are_maximal_and_disjoint(text, item):
    found = d.tiles(text, item, 3)
    seen_t, seen_i = set(), set()
    for t, i, n in found:
        assert n >= 3 and text[t : t + n] == item[i : i + n]
        for k in range(n):
            assert t + k not in seen_t and i + k not in seen_i
            seen_t.add(t + k)
            seen_i.add(i + k)
    assert found == greedy_tiles(text, item, 3)
    left_t = [x if k not in seen_t else -1 - k for k, x in enumerate(text)]
    left_i = [x if k not in seen_i else -1000 - k for k, x in enumerate(item)]
    assert greedy(left_t, left_i, 3) == 0


@settings(max_examples=100, deadline=None)
@given(st.randoms())
def test_tiles_cover_as_much_as_brute_force(r):
    item = [r.randrange(1000) for _ in range(60)]
    cuts = sorted(r.sample(range(60), 4))
    parts = [item[a:b] for a, b in zip([0, *cuts], [*cuts, 60])]
    r.shuffle(parts)
    text = [x for p in parts for x in (*p, 5000 + r.randrange(9))]
    assert sum(n for _, _, n in d.tiles(text, item, 5)) == greedy(text, item, 5)


def test_planted_passages(spark):
    items = [(i, prose(40, 900 + i)) for i in range(30)] + [(90, "too short"), (91, None), (92, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    r = random.Random(3)
    docs, want = list(AWKWARD), set()
    for i in range(30):
        words = items[i][1].split()
        if i % 3 == 0:
            words = words[20:] + words[:20]  # reordered
        if i % 3 == 1:
            words[20] = "changed"
        host = prose(300, i).split()
        at = r.randrange(300)
        docs.append((1000 + i, " ".join(host[:at] + words + host[at:]).upper()))
        want.add((1000 + i, i))
        docs.append((2000 + i, " ".join(host[:at] + words[:9] + host[at:])))  # a quarter only
    table = documents(spark, docs, extra=True)
    rows = d.contaminated(table, bench).collect()
    assert {(x.doc_id, x.item_id) for x in rows} == want
    assert all(0.5 <= x.coverage <= 1 and x.matched_words <= x.item_words for x in rows)
    kept = d.drop_contaminated(table, bench)
    assert kept.columns == table.columns
    assert sorted(map(str, kept.collect())) == sorted(str(x) for x in table.collect() if (x.doc_id or 0) not in range(1000, 1030))
    assert d.contaminated(table, bench.limit(0)).count() == 0
    assert d.contaminated(table.limit(0), bench).count() == 0


def brute(docs, items, least=5, threshold=0.5):
    """Every document against every item, whole."""
    out = []
    for doc, text in docs:
        for item_id, item in items:
            words, own = d.WORD.findall((text or "").lower()), d.WORD.findall((item or "").lower())
            if not own:
                continue
            if len(own) < least:
                hit = any(d.WORD.findall(line) == own for line in (text or "").lower().split("\n"))
                found = [(0, 0, len(own))] if hit else []
            else:
                found = greedy_tiles(words, own, least)
            n = sum(x for _, _, x in found)
            if n and n >= threshold * len(own):
                out.append((str(doc), str(item_id), len(own), n, len(found), round(n / len(own), 9)))
    return sorted(out)


def cases(seed):
    r = random.Random(seed)
    shared = prose(12, 5).split()
    items = [(i, " ".join([*shared, *prose(r.randrange(6, 30), 900 + i).split()])) for i in range(12)]
    items += [(3, items[3][1]), (3, prose(20, 444)), (None, prose(15, 555)), (90, "only three words"), (91, None), (92, ""), (93, "one"), (94, "word " * 9)]
    items += [(95, "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed"), (96, "\u4f60\u597d")]
    docs = list(AWKWARD)
    for n in range(40):
        words = prose(r.randrange(0, 60), 50 + n).split()
        for _ in range(r.randrange(0, 3)):
            own = (r.choice(items)[1] or "").split()
            if own:
                a, b = sorted((r.randrange(len(own) + 1), r.randrange(len(own) + 1)))
                at = r.randrange(len(words) + 1)
                words[at:at] = own[b:] + own[a:b] if r.random() < 0.5 else own[: max(a, b)]
        docs.append((r.randrange(100, 120), " ".join(words)))
    docs += [(200, "Only three,\nwords\nonly three words!\nend"), (201, "there are only three words here"), (202, "\u4ed6\u8bf4\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u73a9"), (203, "\u4f60\u597d\uff01\n"), (204, "\u4f60\u597d\u5417"), (205, "one")]
    return docs, items


def test_rows_equal_brute_force(spark):
    for seed in (1, 2):
        docs, items = cases(seed)
        bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
        rows = d.contaminated(documents(spark, docs, extra=True).repartition(4), bench).collect()
        got = sorted((str(x.doc_id), str(x.item_id), x.item_words, x.matched_words, x.n_tiles, round(x.coverage, 9)) for x in rows)
        assert got == brute(docs, items) and len(got) > 20


def test_a_full_filter_gives_the_same(spark, monkeypatch):
    docs, items = cases(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = documents(spark, docs)
    whole = sorted(map(str, d.contaminated(table, bench).collect()))
    original = d._filter_of

    def full(seeds):
        out = original(seeds)
        out.bits[:] = 255
        return out

    monkeypatch.setattr(d, "_filter_of", full)
    assert sorted(map(str, d.contaminated(table, bench).collect())) == whole


def test_very_long_text(spark):
    item = prose(60, 1)
    host = prose(5000, 2)
    text = " ".join(f"{host} part{k}" for k in range(60)) + " " + item
    assert len(text) > 1_500_000
    rows = d.contaminated(documents(spark, [(1, text), (2, "short")]), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.item_id, x.matched_words) for x in rows] == [(1, 5, 60)]


def test_spared_seeds_are_never_needed():
    """However tiles lie, an item covered enough shares at least the needed number of windows."""
    for n in range(5, 80):
        # the fewest windows with which tiles of at least five words cover so many words
        fewest = {0: 0}
        for words in range(1, n + 1):
            fewest[words] = min((fewest[max(0, words - k)] + k - 4 for k in range(5, n + 1)), default=0)
        assert 1 <= d.needed_seeds(n, 0.5, 5) <= fewest[-(-n // 2)]
