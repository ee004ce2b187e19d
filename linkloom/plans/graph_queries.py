"""Queries over the part graph: an edge leads from each line item's part to that of the order's next line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators import graph, paths, report
from linkloom.plans.registry import query
from linkloom.scratch import written
from linkloom.sources.tables import table

_EDGES = """e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a
  JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""
_LAYERS = """walk AS (SELECT {start} AS v, 0 AS d UNION SELECT e.dst, d + 1 FROM walk JOIN e ON e.src = v WHERE d < 9),
  layers AS (SELECT v, min(d) AS dist FROM walk GROUP BY v)"""
#: Start: the least source. End: the least of the deepest vertices that two edges of shortest paths enter.
_ENDS = """ends AS (SELECT min(v) AS b FROM (SELECT l.v, l.dist FROM layers l JOIN e ON e.dst = l.v JOIN layers p ON p.v = e.src AND p.dist + 1 = l.dist
  GROUP BY l.v, l.dist HAVING count(*) >= 2) WHERE dist = (SELECT max(dist) FROM (SELECT l.dist FROM layers l JOIN e ON e.dst = l.v JOIN layers p ON p.v = e.src
  AND p.dist + 1 = l.dist GROUP BY l.v, l.dist HAVING count(*) >= 2)))"""


def _paths_sql(select: str, edges: str = _EDGES, start: str = "(SELECT min(src) FROM e)", ends: str = _ENDS) -> str:
    return f"""WITH RECURSIVE {edges}, {_LAYERS.format(start=start)}, {ends},
    back AS (SELECT b AS head, [b] AS path, dist AS d FROM ends JOIN layers ON v = b
      UNION ALL SELECT e.src, list_prepend(e.src, path), d - 1 FROM back JOIN e ON e.dst = head JOIN layers p ON p.v = e.src AND p.dist = d - 1 WHERE d > 0),
    found AS (SELECT path FROM back WHERE d = 0)
    {select}"""


def line_steps(spark, sf_dir: str) -> DataFrame:
    """Edges as the orders state them, some more than once; lines are shuffled once, by order."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey is not null and l_linenumber is not null").select("l_orderkey", "l_linenumber", "l_partkey")
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1)
    # as structs, so that a line without a part counts as well
    found = lines.select(F.col("l_partkey").alias("src"), F.collect_set(F.struct("l_partkey")).over(after).alias("next"))
    return found.select("src", F.explode("next").alias("next")).select("src", F.col("next.l_partkey").alias("dst"))


def part_edges(spark, sf_dir: str) -> DataFrame:
    return line_steps(spark, sf_dir).distinct()


def laid_out(spark, sf_dir: str) -> paths.Adjacency:
    return paths.adjacency(line_steps(spark, sf_dir))


def first_source(edges: paths.Adjacency) -> int:
    return edges.edges.agg(F.min("src")).first()[0]


def search(edges: paths.Adjacency) -> tuple[int, int, paths.Dag]:
    """The start and end that the queries use, and the shortest paths from the start that the search for the end has found."""
    start = first_source(edges)
    dag = paths.shortest_path_dag(edges, [start])
    tied = dag.predecessors().groupBy("v", "dist").agg(F.count("*").alias("n")).where("n >= 2")
    return start, tied.agg(F.min_by("v", F.struct(-F.col("dist"), "v"))).first()[0], dag


def _text(found: DataFrame) -> DataFrame:
    return found.select(F.array_join(F.transform("path", lambda v: v.cast("string")), "-").alias("path"), (F.size("path") - 1).cast("long").alias("length"))


_TEXT = "SELECT array_to_string(path, '-') AS path, CAST(len(path) - 1 AS BIGINT) AS length FROM found"


@query("part_edges", f"WITH {_EDGES} SELECT src, dst FROM e")
def part_edges_query(spark, sf_dir):
    return part_edges(spark, sf_dir)


@query("all_shortest_paths", _paths_sql(_TEXT))
def all_shortest_paths(spark, sf_dir):
    edges = laid_out(spark, sf_dir)
    start, end, dag = search(edges)
    return _text(paths.all_shortest_paths(edges, start, end, dag=dag))


@query("predecessors", f"WITH RECURSIVE {_EDGES}, {_LAYERS.format(start='(SELECT min(src) FROM e)')} SELECT l.v, e.src AS pred, CAST(l.dist AS BIGINT) AS dist FROM layers l JOIN e ON e.dst = l.v JOIN layers p ON p.v = e.src AND p.dist + 1 = l.dist")
def predecessors(spark, sf_dir):
    """Each vertex with those before it on shortest paths from the least source."""
    edges = laid_out(spark, sf_dir)
    found = paths.shortest_path_dag(edges, [first_source(edges)]).predecessors()
    return found.select("v", "pred", F.col("dist").cast("long").alias("dist"))


@query(
    "path_counts",
    f"""WITH RECURSIVE {_EDGES}, {_LAYERS.format(start='(SELECT min(src) FROM e)')},
    walks AS (SELECT v, 0 AS d FROM layers WHERE dist = 0 UNION ALL SELECT e.dst, d + 1 FROM walks JOIN e ON e.src = walks.v JOIN layers l ON l.v = e.dst AND l.dist = d + 1)
    SELECT v, CAST(d AS BIGINT) AS dist, CAST(count(*) AS BIGINT) AS n FROM walks GROUP BY v, d""",
)
def path_counts(spark, sf_dir):
    """How many shortest paths lead to each vertex; none of them is made."""
    edges = laid_out(spark, sf_dir)
    found = paths.shortest_path_dag(edges, [first_source(edges)]).distances()
    return found.select("v", F.col("dist").cast("long").alias("dist"), F.col("n").cast("long").alias("n"))


@query("path_slice", _paths_sql("SELECT CAST(r - 1 AS BIGINT) AS rank, array_to_string(path, '-') AS path FROM (SELECT path, row_number() OVER (ORDER BY list_reverse(path)) AS r FROM found) WHERE r BETWEEN 3 AND 9"))
def path_slice(spark, sf_dir):
    """The third to the ninth of the shortest paths, by their numbers."""
    _, end, dag = search(laid_out(spark, sf_dir))
    found = dag.slice(end, 2, 7)
    return found.select(F.col("rank").cast("long").alias("rank"), F.array_join(F.transform("path", lambda v: v.cast("string")), "-").alias("path"))


@query("bidirectional_paths", _paths_sql(_TEXT))
def bidirectional_paths(spark, sf_dir):
    edges = laid_out(spark, sf_dir)
    start, end, _ = search(edges)
    return _text(paths.bidirectional_paths(edges, start, end))


@query(
    "bfs_layers",
    f"WITH RECURSIVE {_EDGES}, {_LAYERS.format(start='(SELECT min(src) FROM e)')} SELECT v, CAST(dist AS BIGINT) AS dist FROM layers",
)
def bfs_layers(spark, sf_dir):
    edges = laid_out(spark, sf_dir)
    return paths.bfs_layers(edges, first_source(edges))


_NAMED = """SELECT '[' || (SELECT string_agg(p_name, ' -> ' ORDER BY i) FROM (SELECT unnest(path) AS v, unnest(range(1, len(path) + 1)) AS i) JOIN part ON p_partkey = v) || ']' AS line FROM found"""


@query("path_display", _paths_sql(_NAMED))
def path_display(spark, sf_dir):
    """Titles along each path; paths of equal titles are a line each."""
    edges = laid_out(spark, sf_dir)
    start, end, dag = search(edges)
    titles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_name").alias("title"))
    return report.path_report(report.titled_paths(paths.all_shortest_paths(edges, start, end, dag=dag), titles), str(start), str(end))


@query("shortest_path_same_vertex", f"WITH {_EDGES} SELECT CAST(min(src) AS VARCHAR) AS path, CAST(0 AS BIGINT) AS length FROM e")
def shortest_path_same_vertex(spark, sf_dir):
    edges = part_edges(spark, sf_dir)
    start = edges.agg(F.min("src")).first()[0]
    return _text(paths.all_shortest_paths(edges, start, start, spark.createDataFrame([(start,)], "v long")))


@query("shortest_path_unreachable", "SELECT 'none' AS path, CAST(0 AS BIGINT) AS length WHERE false")
def shortest_path_unreachable(spark, sf_dir):
    edges = part_edges(spark, sf_dir)
    return _text(paths.all_shortest_paths(edges, edges.agg(F.min("src")).first()[0], -1))


_KEPT = """e0 AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a
  JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
  e AS (SELECT src, dst FROM e0 WHERE dst % 3 <> 1)"""


@query("shortest_path_removed", _paths_sql(_TEXT, edges=_KEPT, ends="ends AS (SELECT max(v) AS b FROM layers WHERE dist = 2)"))
def shortest_path_removed(spark, sf_dir):
    """Every third part is removed; to the largest part two edges away."""
    edges = written(part_edges(spark, sf_dir), "edges")
    removed = table(spark, sf_dir, "part").where("p_partkey % 3 = 1").select("p_partkey")
    start = edges.where("dst % 3 <> 1").agg(F.min("src")).first()[0]
    near = paths.bfs_layers(edges, start, removed, max_layers=2).where("dist = 2")
    return _text(paths.all_shortest_paths(edges, start, near.agg(F.max("v")).first()[0], removed))


_LEGS = [("0", "1"), ("1", "7"), ("7", "5")]


def _leg_sql(k: int, a: str, b: str) -> str:
    inner = _paths_sql("SELECT path FROM found", start=f"CAST({a} AS BIGINT)", ends=f"ends AS (SELECT CAST({b} AS BIGINT) AS b)")
    return f"SELECT CAST({k} AS BIGINT) AS leg, array_to_string(path, '-') AS path FROM ({inner})"


@query("path_chain", " UNION ALL ".join(_leg_sql(k, a, b) for k, (a, b) in enumerate(_LEGS)))
def path_chain(spark, sf_dir):
    edges = laid_out(spark, sf_dir)
    chain = paths.path_chain(edges, [0, 1, 7, 5])
    return chain.select("leg", F.array_join(F.transform("path", lambda v: v.cast("string")), "-").alias("path"))


@query(
    "path_by_title",
    _paths_sql(_TEXT, ends="ends AS (SELECT max(p_partkey) AS b FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 11))", start="(SELECT max(p_partkey) FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 3))"),
)
def path_by_title(spark, sf_dir):
    edges = written(part_edges(spark, sf_dir), "edges")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_partkey").alias("unique_id"), F.col("p_name").alias("title"))
    names = {r.path: r.title for r in part.where("path in (3, 11)").collect()}
    return _text(paths.paths_between_titles(edges, part, names[3], names[11]))


@query("neighbours", f"WITH {_EDGES} SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT dst FROM e WHERE src = 5)")
def neighbours(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_name")
    return graph.neighbours(part_edges(spark, sf_dir), part, 5).withColumnRenamed("path", "p_partkey")


@query(
    "neighbour_sets",
    f"WITH {_EDGES} SELECT src, count(*) AS n, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM e GROUP BY src",
)
def neighbour_sets(spark, sf_dir):
    sets = graph.neighbour_sets(part_edges(spark, sf_dir))
    return sets.select("src", F.size("neighbours").cast("long").alias("n"), F.array_join(F.transform("neighbours", lambda v: v.cast("string")), ",").alias("neighbours"))


@query("neighbour_union", f"WITH {_EDGES} SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def neighbour_union(spark, sf_dir):
    """All edges are stored; all of them turned round are cached."""
    edges = part_edges(spark, sf_dir)
    return graph.union_neighbours(edges, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query(
    "chain_graph",
    "SELECT DISTINCT a.conv_id, a.turn AS src, b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
)
def chain_graph(spark, sf_dir):
    """Each turn of a conversation leads to the next."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("dst"))
    return turns.join(nxt, ["conv_id", "turn"]).select("conv_id", F.col("turn").alias("src"), "dst")


@query("page_ids", "SELECT p_partkey, row_number() OVER (ORDER BY lpad(CAST(p_partkey AS VARCHAR), 12, '0')) + 99 AS unique_id FROM part")
def page_ids(spark, sf_dir):
    """Dense ids in order of path, counted per range partition."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("path"))
    return graph.with_ids(part, 100).select("p_partkey", "unique_id")
