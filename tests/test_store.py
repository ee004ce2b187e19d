"""The store's layout, lookups and indexes."""

import glob
import os
import re

import pytest

from linkloom import schema
from linkloom.operators.services import Pages
from linkloom.operators.store import Delta, GraphStore


def page(path, title, k=0):
    return (path, k, title, "", False, "", False, {})


def pages(spark, *rows):
    return spark.createDataFrame([page(*r) for r in rows], schema.PAGES)


def links(spark, *rows):
    return spark.createDataFrame(list(rows), schema.RAW_LINKS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def broadcast_off(spark):
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_a_lookup_opens_the_buckets_of_its_keys(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}", buckets=64)
    store.commit(pages=pages(spark, *[(f"p{k}", f"t{k}", k) for k in range(3000)]))
    store.commit(pages=pages(spark, *[(f"p{k}", "new", k) for k in range(0, 3000, 7)]))
    asked = [f"p{k}" for k in (1, 7, 2999)]
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan shows the buckets
    shown = plan(store.lookup("pages", asked))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    chosen = [(int(a), int(b)) for a, b in re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", shown)]
    assert chosen and all(a <= 3 and b == 64 for a, b in chosen)
    # the same, by what is opened: no file of another bucket can be read any more
    own = {re.search(r"_(\d{5})\.c000", r.f).group(1) for r in spark.table(store._table("pages", "rows")).selectExpr("path", "_metadata.file_name AS f").where("path in ('p1', 'p7', 'p2999')").collect()}
    files = glob.glob(f"{tmp_path}/pages/rows/*/part-*.parquet")
    others = [f for f in files if re.search(r"_(\d{5})\.c000", f).group(1) not in own]
    assert len(files) > 100 and len(files) - len(others) <= 6
    for f in others:
        with open(f, "wb") as broken:
            broken.write(b"no parquet")
        if os.path.exists(crc := os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")):
            os.remove(crc)
    assert {(r.path, r.title) for r in store.lookup("pages", asked).collect()} == {("p1", "t1"), ("p7", "new"), ("p2999", "t2999")}


def test_a_lookup_by_a_table_moves_the_keys_alone(spark, tmp_path, broadcast_off):
    store = GraphStore(spark, f"file://{tmp_path}", buckets=8)
    for n in range(3):
        store.commit(pages=pages(spark, *[(f"p{k}", f"t{n}", k) for k in range(n, 500 + n)]))
    asked = spark.range(2000).selectExpr("concat('p', id) AS path")
    found = store.lookup("pages", asked)
    lines = plan(found).splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    scans = [k for k, line in enumerate(lines) if "FileScan" in line]
    assert scans
    for k in scans:  # between a scan and the first join above it nothing is exchanged
        level = depth(lines[k])
        for line in reversed(lines[:k]):
            if depth(line) < level:
                level = depth(line)
                assert "Exchange" not in line, line
                if "Join" in line:
                    break
    want = {f"p{k}": f"t{min(k, 2)}" for k in range(502)}
    assert {r.path: r.title for r in found.collect()} == want


def test_another_session_finds_the_tables(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}", buckets=4)
    store.commit(pages=pages(spark, ("a", "x"), ("b", "y")))
    store.commit(pages=pages(spark, ("b", "z")))
    for of in ("rows",):
        spark.sql(f"DROP TABLE {store._table('pages', of)}")
    again = GraphStore(spark, f"file://{tmp_path}", buckets=9)  # the buckets it was made with count
    assert {(r.path, r.title) for r in again.read("pages").collect()} == {("a", "x"), ("b", "z")}
    again.commit(pages=pages(spark, ("c", "w")))
    assert {r.path for r in again.lookup("pages", ["b", "c"]).collect()} == {"b", "c"}
    assert again._buckets() == 4 and {r.title for r in again.read("pages", version=0).collect()} == {"x", "y"}


def test_merged_deltas_leave_no_folders(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}", parts=2, buckets=2)
    for n in range(6):
        store.commit(pages=pages(spark, (f"p{n}", "t")), raw_links=Delta(links(spark, (f"p{n}", "x")), links(spark, ("p0", "")).select("src_path")))
    store.vacuum(keep=1)
    named = {(t, p["v"]) for t, parts in store._manifest().items() for p in parts}
    there = {(os.path.basename(os.path.dirname(os.path.dirname(f))), int(f.rsplit("=", 1)[1])) for f in glob.glob(f"{tmp_path}/*/*/__v=*")}
    assert there == named
    assert store.read("pages").count() == 6 and {r.src_path for r in store.read("raw_links").collect()} == {f"p{n}" for n in range(1, 6)}


def test_titles_move_with_a_rename(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}", parts=2, buckets=16)
    services = Pages(store)
    titles = lambda t: sorted(r.path for r in services.by_title(t).collect())
    services.insert(pages(spark, ("a", "one", 0), ("b", "one", 1), ("c", None, 2), ("d", "", 3)))
    assert titles("one") == ["a", "b"] and titles("") == ["d"] and titles("none") == []
    services.save(spark.createDataFrame([("a", "two")], "path string, title string"))
    assert titles("one") == ["b"] and titles("two") == ["a"]
    services.save(spark.createDataFrame([("a", "one"), ("c", "two")], "path string, title string"))
    services.create_bare(pages(spark, ("b", "never"), ("e", "two", 9)))
    services.insert(pages(spark, ("b", "one", 1)))  # the same again changes nothing
    assert titles("one") == ["a", "b"] and titles("two") == ["c", "e"] and titles("never") == []
    services.insert(pages(spark, ("f", "six", 10)))
    store.commit(pages=Delta(replaced=spark.createDataFrame([("f",)], "path string")))  # a page that is taken out takes its title along
    assert titles("six") == [] and services.by_path("f").count() == 0
    asked = spark.createDataFrame([(0, "two"), (1, "one")], "position long, title string")
    assert {(r.position, r.path) for r in services.by_titles(asked).collect()} == {(0, "e"), (1, "b")}
    assert services.by_titles(spark.createDataFrame([(0, "two"), (1, "gone")], asked.schema)).count() == 0
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    shown = plan(services.by_title("two"))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert all(int(n) <= 2 for n in re.findall(r"SelectedBucketsCount: (\d+) out of", shown)) and "SelectedBucketsCount" in shown


def test_waiting_links_are_kept_up(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}", parts=2, buckets=4)
    waiting = lambda: {(r.dst_path, *r.sources) for r in Pages(store).pending().collect()}
    own = lambda *src: spark.createDataFrame([(s,) for s in src], "src_path string")
    store.commit(pages=pages(spark, ("a", "a"), ("b", "b")), raw_links=Delta(links(spark, ("a", "b"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "b")), own("a", "b")))
    assert waiting() == {("x", "a", "b"), ("y", "a")}
    # the same again, and one link less
    store.commit(raw_links=Delta(links(spark, ("a", "x"), ("a", "b")), own("a")))
    assert waiting() == {("x", "a", "b")}
    store.commit(raw_links=Delta(links(spark, ("b", "z"), ("b", "x"), ("b", "z")), adds=True))
    assert waiting() == {("x", "a", "b"), ("z", "b")}
    assert {r.path for r in Pages(store).waiting_for("x").collect()} == {"a", "b"}
    # a page comes: nothing waits for it any more; then it is stated anew and does not wait either
    store.commit(pages=pages(spark, ("x", "x")), raw_links=Delta(links(spark, ("x", "z")), own("x")))
    assert waiting() == {("z", "b", "x")}
    store.commit(raw_links=Delta(links(spark, ("a", "x"), ("a", "q")), own("a")))
    assert waiting() == {("z", "b", "x"), ("q", "a")}
    store.commit(raw_links=Delta(replaced=own("a", "b")))
    assert waiting() == {("z", "x")}
