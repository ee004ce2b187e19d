import re
from collections import Counter

from helpers import AWKWARD, documents, prose
from pyspark.sql import functions as F

from linkloom.llm import chat_collapse, quality, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_python(spark):
    docs = AWKWARD + [(100 + k, prose(60, k) + "\n" + prose(9, 1) + "\n" + prose(9, 1) + " # $% " + prose(30, 50 + k)) for k in range(10)]
    docs.append((500, "\n".join(["a line that stands twice", "", " \t", "a line that stands twice", "a line that stands twice ", "b\x0bc\x0cd\re"])))
    docs.append((501, " ".join(str(i % 700) for i in range(30_000))))
    docs.append((502, "\xa0nbsp is no space \u2003 nor is em space " * 20))
    rows = quality.judge(documents(spark, docs, extra=True).withColumnRenamed("n_words", "w")).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = []
    for d, t in docs:
        c = counts(t)
        want.append((str(d), *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want)
    assert all(not r.kept for r in rows if r.base_failed)
    assert any(r.kept for r in rows)


def test_windows_that_share_hash_bits_are_told_apart(spark, monkeypatch):
    """With two bits of each hash left, nearly all neighbours collide."""
    monkeypatch.setattr(quality, "SPARE_BITS", 52)
    docs = [(k, prose(120, k) + " " + prose(20, 3) + " end " + prose(20, 3)) for k in range(6)]
    rows = quality.judge(documents(spark, docs)).collect()
    assert {r.doc_id: r.n_repeat_words for r in rows} == {d: counts(t)[4] for d, t in docs}


def test_the_verdict_needs_no_sort_of_texts_that_repeat_little(spark):
    """A repeat too small to fail the base is not worked out for the verdict; at the rule's edge both forms agree."""
    phrase = "one two three four"
    docs = [(k, " ".join([phrase] * k + [f"w{k}x{i}" for i in range(60 - 4 * k)])) for k in range(13)]
    docs += [(100 + k, " ".join(f"v{i % (60 - k)}" for i in range(60))) for k in range(0, 50, 5)]
    full = {r.doc_id: r for r in quality.with_counts(documents(spark, docs)).collect()}
    brief = {r.doc_id: r for r in quality.with_counts(documents(spark, docs), exact=False).collect()}
    failed = {d for d, r in full.items() if 100 * r.n_repeat_words > 50 * r.n_words}
    assert failed == {d for d, r in brief.items() if 100 * r.n_repeat_words > 50 * r.n_words} and 3 < len(failed) < len(docs)
    assert full[2].n_repeat_words == 8 and brief[2].n_repeat_words == 0


def test_counts_replace_columns_of_their_name(spark):
    table = documents(spark, [(1, "two words")], extra=True)
    assert [r.n_words for r in quality.with_counts(table).collect()] == [2]
    assert quality.keep_good(table).columns == table.columns


def test_keep_good_keeps_columns(spark):
    docs = AWKWARD + [(100 + k, prose(80, k)) for k in range(5)] + [(200, prose(80, 1).upper()), (201, "# " * 100 + prose(80, 2))]
    table = documents(spark, docs, extra=True)
    kept = quality.keep_good(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [100, 101, 102, 103, 104]
    assert quality.keep_good(table.limit(0)).count() == 0 and quality.judge(table.limit(0)).count() == 0


def test_quality_is_native(spark):
    plan = quality.judge(documents(spark, AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


URLS = [
    (0, None), (1, ""), (2, "no scheme"), (3, "http://EXAMPLE.org/en/1x?q=1#f"), (4, "https://a.example.org/en/2"), (5, "http://example.org"),
    (6, "http://notexample.org/es/"), (7, "http://sub.Example.ORG/es/p"), (8, "ftp://x.com/fr/a"), (9, "http://x.com/de/a#z"), (10, "http://y.net/a/?utm_source=f&page=2"),
    (11, "https://Y.net/a?page=2"), (12, "http://y.net/a?page=3"), (13, "http://z.net?x://y"), (13, "http://z.net/"), (None, "http://u.net/one"), (15, "://h/p"), (16, "a://b://c/d"),
]


def test_url_filter(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS block")
    rows = url_filter.judge_urls(pages, url_filter.mirrored_urls(pages)).collect()
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(URLS)
    assert got == {
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "example.org", "/en/1x", "example.org/en/1", "block"),
        (4, "a.example.org", "/en/2", "org/", "allow"), (5, "example.org", "", None, "allow"), (6, "notexample.org", "/es/", "org/", "allow"),
        (7, "sub.example.org", "/es/p", "example.org/es/", "block"), (8, "x.com", "/fr/a", "com/fr/", "allow"), (9, "x.com", "/de/a", "com/de/", "block"),
        (10, "y.net", "/a/", None, "block"), (11, "y.net", "/a", None, "block"), (12, "y.net", "/a", None, "allow"), (13, "z.net", "", None, "allow"), (13, "z.net", "/", None, "allow"),
        (None, "u.net", "/one", None, "allow"), (15, "h", "/p", None, "allow"), (16, "b:", "//c/d", None, "allow"),
    }
    assert url_filter.judge_urls(pages.limit(0), url_filter.mirrored_urls(pages)).count() == 0
    assert url_filter.judge_urls(pages, pages.limit(0).selectExpr("url AS canonical")).where("listed").count() == 0


def test_bloom_filter_misses_nothing(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h.net/"), "id").alias("canonical"))
    rows = spark.range(20_000).select("id", F.concat(F.lit("h.net/"), "id").alias("canonical"))
    for size in (None, 10**5):  # by shuffle, and by broadcast
        assert url_filter.listed_hits(rows, listed, 5000, size).where("listed != (id < 5000)").count() == 0
    full = url_filter.listed_hits(rows, listed, 1, None)  # one block for all: it stops nothing, and the result is the same
    assert full.where("listed != (id < 5000)").count() == 0
    blocks = url_filter.bloom_blocks(listed, 512)
    lanes = url_filter._lanes("canonical", 512)
    hit = rows.where("id >= 5000").withColumn("block", lanes["block"]).join(blocks, "block")
    for j in range(4):
        hit = hit.where(F.col(f"w{j}").bitwiseAND(lanes[f"m{j}"]) == lanes[f"m{j}"])
    assert hit.count() < 0.01 * 15_000


def talk(conv, turns, start=0):
    return [(conv, start + k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(turns)]


def test_chat_collapse(spark):
    long = [f"turn {k}" for k in range(80)]
    rows = talk(1, long) + talk(2, long[:40]) + talk(3, long[:40]) + talk(4, long) + talk(5, long[:39] + ["other"])
    rows += talk(6, ["hi"]) + talk(7, ["hi", "there"]) + talk(8, ["hello"]) + [(9, None, None, None), (9, 0, "user", "x"), (None, 0, "user", "y")]
    rows += [(10, 0, "user", "a"), (10, 0, "user", "a"), (11, 0, "user", "a"), (11, 1, "assistant", "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "2 AS blk")
    kept = {(r.conv_id, r.n_snapshots) for r in chat_collapse.maximal(table).collect()}
    assert kept == {(1, 2), (5, 1), (7, 1), (8, 1), (9, 1), (10, 1), (11, 1)}
    text = {r.conv_id: r.conversation for r in chat_collapse.assemble(chat_collapse.render(table)).collect()}
    assert text[7] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nthere<|im_end|>\n"
    assert text[1] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, _, r, t in talk(1, long))
    assert chat_collapse.render(table.limit(0)).count() == 0
