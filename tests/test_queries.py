"""Every registered query of the engine against its SQL oracle on the smallest tables."""

import os
import re

import duckdb
import pytest

from linkloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(cells, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(str([tidy(r[i]) for i in order]) for r in cells)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(got, df.columns) == rows(want.fetchall(), columns)


def test_ids_are_dense_with_few_partitions(spark):
    """Ranges are drawn from a sample here, not from all rows; ids are unique all the same."""
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = [r.unique_id for r in catalog.queries()["page_ids"](spark, "/root/testdata/sf0.01").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", had)
    assert sorted(ids) == list(range(100, 100 + len(ids)))


def test_both_searches_answer_for_the_same_ends(spark):
    found = [sorted(map(tuple, catalog.queries()[name](spark, "/root/testdata/sf0.001").collect())) for name in ("bidirectional_paths", "all_shortest_paths")]
    assert found[0] == found[1] and found[0]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
