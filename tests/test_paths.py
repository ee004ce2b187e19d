import random

import pytest
from fixtures import graph_edges

from linkloom.operators import paths

DAG = [(0, 1), (0, 2), (0, 3), (0, 4), (1, 4), (2, 5), (3, 5), (4, 6), (5, 6)]
STRATEGIES = [paths.all_shortest_paths, paths.bidirectional_paths]


def brute(edges, start, end, removed=()):
    """All shortest paths by breadth-first search over whole paths."""
    if start == end:
        return {(end,)}
    layer, seen = [(start,)], {start}
    while layer:
        nxt = [p + (b,) for p in layer for a, b in edges if a == p[-1] and b not in seen and b not in removed]
        found = {p for p in nxt if p[-1] == end}
        if found:
            return found
        seen |= {p[-1] for p in nxt}
        layer = nxt
    return set()


def run(spark, strategy, edges, start, end, removed=()):
    kind = "string" if isinstance(start, str) else "long"
    table = spark.createDataFrame(sorted(edges), f"src {kind}, dst {kind}")
    gone = spark.createDataFrame([(r,) for r in removed], f"v {kind}") if removed else None
    rows = [tuple(r.path) for r in strategy(table, start, end, gone).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_seven_pages(spark, strategy):
    edges = graph_edges()
    go = lambda a, b, gone=(): {"-".join(p) for p in run(spark, strategy, edges, a, b, gone)}
    assert go("5", "6") == {"5-4-3-1-7-6", "5-4-3-2-7-6"}
    assert go("4", "4") == {"4"}
    assert go("1", "99") == set()
    assert go("5", "7", ("1",)) == {"5-4-3-2-7"}
    assert go("1", "5", ("5",)) == set()


def test_small_dag(spark):
    go = lambda a, b: run(spark, paths.all_shortest_paths, DAG, a, b)
    assert go(0, 5) == {(0, 2, 5), (0, 3, 5)}
    assert go(0, 6) == {(0, 4, 6)}
    assert go(6, 0) == set()
    assert go(0, 0) == {(0,)}


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_random_graphs(spark, strategy):
    r = random.Random(11)
    for n, m in ((6, 12), (9, 20), (12, 30)):
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
        start, end, removed = 0, n - 1, (r.randrange(1, n),)
        assert run(spark, strategy, edges, start, end, removed) == brute(edges, start, end, removed)


def test_removed_start_may_be_left(spark):
    assert run(spark, paths.all_shortest_paths, DAG, 0, 4, (0,)) == {(0, 4)}


def test_null_ends_and_repeated_edges(spark):
    edges = spark.createDataFrame(DAG + DAG, "src long, dst long")
    assert paths.all_shortest_paths(edges, None, 3).count() == 0
    assert paths.all_shortest_paths(edges, 0, None).count() == 0
    assert paths.all_shortest_paths(edges, 0, 5).count() == 2


def test_chain_and_titles(spark):
    edges = spark.createDataFrame(DAG, "src long, dst long")
    legs = {(r.leg, tuple(r.path)) for r in paths.path_chain(edges, [0, 5, 6, 0]).collect()}
    assert legs == {(0, (0, 2, 5)), (0, (0, 3, 5)), (1, (5, 6))}
    assert paths.path_chain(edges, [3]).count() == 0
    pages = spark.createDataFrame([(k, k, f"t{k % 6}", k == 2) for k in range(7)], "path long, unique_id long, title string, is_removed boolean")
    found = paths.paths_between_titles(edges, pages, "t0", "t5")  # t0 is page 6, the last of two
    assert found.count() == 0
    assert [r.path for r in paths.paths_between_titles(edges, pages.where("path < 6"), "t0", "t5").collect()] == [[0, 3, 5]]
    assert paths.paths_between_titles(edges, pages, "t0", "nowhere").count() == 0


def test_layers(spark):
    edges = spark.createDataFrame(DAG + [(6, 0)], "src long, dst long")
    assert {(r.v, r.dist) for r in paths.bfs_layers(edges, 0).collect()} == {(0, 0), (1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2)}


def laid(spark, edges, buckets=8):
    return paths.adjacency(spark.createDataFrame(sorted(edges), "src long, dst long"), buckets)


def test_dag_counts_and_slices(spark):
    r = random.Random(5)
    edges = {(r.randrange(14), r.randrange(14)) for _ in range(60)}
    adj = laid(spark, edges)
    dag = paths.shortest_path_dag(adj, [0])
    every = {v: brute(edges, 0, v) for v in range(14)}
    assert {(x.v, x.dist, int(x.n)) for x in dag.distances().collect()} == {(v, len(next(iter(p))) - 1, len(p)) for v, p in every.items() if p}
    want = {(p[k + 1], p[k], k + 1) for paths_ in every.values() for p in paths_ for k in range(len(p) - 1)}
    assert {(x.v, x.pred, x.dist) for x in dag.predecessors().collect()} == want
    end = max((v for v in every if every[v]), key=lambda v: len(every[v]))
    order = sorted(every[end], key=lambda p: p[::-1])
    for first, count in ((0, 2), (1, 3), (len(order) - 1, 9), (len(order), 5), (0, 0)):
        got = {int(x.rank): tuple(x.path) for x in dag.slice(end, first, count).collect()}
        assert got == {first + k: p for k, p in enumerate(order[first : first + count])}
    assert {tuple(x.path) for x in paths.all_shortest_paths(adj, 0, end, dag=dag).collect()} == every[end]
    assert {tuple(x.path) for x in paths.bidirectional_paths(adj, 0, end).collect()} == every[end]
    assert dag.slice(99, 0, 1).count() == 0


def test_one_path_of_many(spark):
    """Twelve diamonds in a row: their 4096 paths are counted, and the one in the middle is found alone."""
    edges = [e for k in range(12) for e in ((3 * k, 3 * k + 1), (3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 3), (3 * k + 2, 3 * k + 3))]
    dag = paths.shortest_path_dag(laid(spark, edges, 2), [0], [36])
    assert int(dag.distances().where("v = 36").first().n) == 2**12
    got = dag.slice(36, 2**11, 1).first()
    assert int(got.rank) == 2**11 and len(got.path) == 25 and got.path[-2] == 35 and got.path[1] == 1


def test_a_layer_shuffles_no_edges(spark):
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    adj = laid(spark, {(a, (a * 7 + k) % 900) for a in range(900) for k in range(3)}, 16)
    frontier = spark.createDataFrame([(0, k) for k in range(500)], "leg int, v long")
    shown = paths._ahead(adj, frontier, 500)._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(k for k, line in enumerate(shown) if "FileScan" in line)
    join = next(k for k, line in enumerate(shown) if "SortMergeJoin" in line)
    assert join < scan and not any("Exchange" in line for line in shown[join:scan])
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    few = paths._ahead(adj, frontier.limit(3), 3)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert any(f"SelectedBucketsCount: {n} out of 16" in few for n in (1, 2, 3))
