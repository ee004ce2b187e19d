"""All shortest paths by layer-synchronous joins.

Forward, each layer is one join of the frontier with the edges and one anti-join
with the table of visited vertices. Tables of layers are one folder with a subfolder
per layer, so each is one scan whatever its depth, plans do not grow, and a lost
executor costs one layer at most. Only vertices are carried forward, each with the
number of shortest paths that lead to it. Then one join of the edges with the vertices
gives, by layer, the predecessors of each vertex: with the numbers they stand for all
shortest paths, however many, without one of them being made. Paths are unrolled
backward over them, all of them or, by their numbers, a slice.
Several searches (the legs of a chain) share the layers: a column ``leg`` tells them apart.

Edges are read once per layer: pass a table, not a long plan. ``adjacency`` lays them out
where the frontier goes: in Spark buckets by source, so that a layer shuffles its frontier
and its candidates but never the edges, and a small frontier opens its own buckets alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.scratch import new_path, release, written

#: Between the vertices of a path as text; no path holds a line break.
SEPARATOR = "\n"


class ShortestPathStrategy(Protocol):
    """All shortest paths from ``start`` to ``end``: one row per path, an array of vertices in ``path``."""

    def __call__(self, edges: DataFrame, start: object, end: object, removed: DataFrame | None = None) -> DataFrame: ...


class DepthReached(RuntimeError):
    """A search was told to end at a depth, and had not found its end there."""


@dataclass
class Adjacency:
    """Distinct edges (src, dst) in buckets by src, sorted."""

    edges: DataFrame
    name: str
    path: str

    def release(self) -> None:
        self.edges.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        release(self.path)


#: Vertices of a frontier up to which they are named one by one, so that only their buckets are opened.
LISTED = 200


def adjacency(edges: DataFrame, buckets: int | None = None) -> Adjacency:
    """Lays edges out for searches: one shuffle by source, which also drops repeated ones. As many buckets as shuffles have partitions, if none are named."""
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, "adjacency")
    name = f"linkloom_{path.rsplit('-', 1)[1]}"
    dealt = edges.select("src", "dst").repartition(buckets, "src").dropDuplicates(["src", "dst"])
    dealt.write.bucketBy(buckets, "src").sortBy("src").option("path", path).format("parquet").saveAsTable(name)
    return Adjacency(spark.table(name), name, path)


def _table(edges: DataFrame | Adjacency) -> DataFrame:
    return edges.edges if isinstance(edges, Adjacency) else edges


@dataclass
class _Layers:
    """Rows by layer: one folder, one subfolder per layer."""

    spark: SparkSession
    path: str
    ddl: str

    def add(self, layer: DataFrame, dist: int) -> None:
        layer.select(*[c.split()[0] for c in self.ddl.split(", ")]).write.parquet(f"{self.path}/dist={dist}")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{self.ddl}, dist int").option("basePath", self.path).parquet(self.path)

    def layer(self, dist: int) -> DataFrame:
        return self.spark.read.schema(self.ddl).parquet(f"{self.path}/dist={dist}")


def _visited(spark: SparkSession, kind: str) -> _Layers:
    return _Layers(spark, new_path(spark, "visited"), f"leg int, v {kind}")


def _kind(edges: DataFrame | Adjacency) -> str:
    return _table(edges).schema["src"].dataType.simpleString()


def _starts(edges: DataFrame | Adjacency, starts: list) -> DataFrame:
    return _table(edges).sparkSession.createDataFrame(list(enumerate(starts)), f"leg int, v {_kind(edges)}")


def _ahead(edges: DataFrame | Adjacency, frontier: DataFrame, size: int | None) -> DataFrame:
    """The edges that leave a frontier, with its columns; its vertex becomes ``pred``. ``size`` is the frontier's, if known."""
    table = _table(edges).select("src", "dst")
    if isinstance(edges, Adjacency) and size is not None and size <= LISTED:
        table = table.where(F.col("src").isin([r.v for r in frontier.select("v").distinct().collect()]))
    return table.join(frontier.withColumnRenamed("v", "src"), "src").withColumnsRenamed({"src": "pred", "dst": "v"})


def _unseen(ahead: DataFrame, seen: DataFrame, removed: DataFrame | None) -> DataFrame:
    """What nothing has reached yet; removed vertices are left out here, among few candidates."""
    if removed is not None:
        ahead = ahead.join(removed.toDF("v").distinct(), "v", "left_anti")
    return ahead.join(seen.select("leg", "v"), ["leg", "v"], "left_anti")


def _step(edges: DataFrame | Adjacency, frontier: DataFrame, seen: DataFrame, removed: DataFrame | None, size: int | None = None) -> DataFrame:
    """(leg, v) that the frontier leads to and nothing has reached."""
    return _unseen(_ahead(edges, frontier.select("leg", "v"), size).select("leg", "v").distinct(), seen, removed).select("leg", "v")


def _is_end(ends: list) -> list[Column]:
    """Per leg, whether a row is that leg's end."""
    return [(F.col("leg") == k) & (F.col("v") == F.lit(end)) for k, end in enumerate(ends)]


#: Numbers of paths; what has more digits than that is null.
COUNT = "decimal(38,0)"


@dataclass
class Dag:
    """All shortest paths from the start of each leg: how many lead to each vertex, and predecessors by layer.

    ``met`` has the layer at which each leg with an end met it.
    """

    graph: DataFrame | Adjacency
    vertices: _Layers
    met: dict[int, int]
    ends: list
    kind: str
    found: _Layers | None = None

    @property
    def edges(self) -> _Layers:
        """(leg, v, pred, n) by layer; n paths lead to the predecessor. Worked out once, when first asked for."""
        if self.found is None:
            spark = self.vertices.spark
            self.found = _Layers(spark, new_path(spark, "predecessors"), f"leg int, v {self.kind}, pred {self.kind}, n {COUNT}")
            reached = self.vertices.rows()
            steps = _ahead(self.graph, reached.withColumn("dist", F.col("dist") + 1), None)
            steps = steps if isinstance(self.graph, Adjacency) else steps.distinct()
            steps = steps.join(reached.select("leg", "v", "dist"), ["leg", "v", "dist"], "left_semi")
            steps.select("leg", "v", "pred", "n", "dist").write.partitionBy("dist").parquet(self.found.path)
        return self.found

    def distances(self) -> DataFrame:
        """(leg, v, dist, n): vertices that were reached, and the number of shortest paths to each."""
        return self.vertices.rows().select("leg", "v", "dist", "n")

    def predecessors(self) -> DataFrame:
        """(leg, v, pred, dist): each vertex with those before it on shortest paths."""
        if self.vertices.rows().where("dist > 0").isEmpty():  # then no folder has been made
            return self.vertices.spark.createDataFrame([], f"leg int, v {self.kind}, pred {self.kind}, dist int")
        return self.edges.rows().select("leg", "v", "pred", "dist")

    def _empty(self) -> DataFrame:
        return self.vertices.spark.createDataFrame([], f"leg long, path array<{self.kind}>")

    def paths(self, ends: list | None = None, met: dict[int, int] | None = None) -> DataFrame:
        """(leg, path): every shortest path of the legs that met their end, or to other ends of known distances."""
        ends, met = (self.ends, self.met) if ends is None else (ends, met)
        if not met:
            return self._empty()
        spark, heads, last = self.vertices.spark, None, None
        for dist in range(max(met.values()), -1, -1):
            own = [(k, end) for k, end in enumerate(ends) if met.get(k) == dist]
            fresh = spark.createDataFrame(own, f"leg int, head {self.kind}").select("leg", "head", F.array("head").alias("path")) if own else None
            if heads is not None:
                into = self.edges.layer(dist + 1).withColumnRenamed("v", "head").join(heads, ["leg", "head"])
                into = into.select("leg", F.col("pred").alias("head"), F.concat(F.array("pred"), F.col("path")).alias("path"))
                fresh = into if fresh is None else into.unionByName(fresh)
            heads = fresh
            if dist % UNROLLED == 0:
                heads = written(heads, "heads")
                release(last)
                last = heads
        return heads.select(F.col("leg").cast("long").alias("leg"), "path")

    def distance(self, end: object, leg: int = 0) -> int | None:
        at = self.vertices.rows().where((F.col("leg") == leg) & (F.col("v") == F.lit(end))).select("dist").first()
        return None if at is None else at.dist

    def slice(self, end: object, first: int, count: int, leg: int = 0) -> DataFrame:
        """(rank, path): the shortest paths to ``end`` numbered ``first`` and on, so many; the others are not made.

        Paths are in order of their vertices from the end to the start. At each layer a
        path that is begun knows which of its continuations are asked for; those of one
        predecessor are as many as paths lead to it.
        """
        dist, spark = self.distance(end, leg), self.vertices.spark
        if dist is None or count <= 0:
            return spark.createDataFrame([], f"rank {COUNT}, path array<{self.kind}>")
        number = lambda x: F.lit(x).cast(COUNT)
        total = self.vertices.layer(dist).where((F.col("leg") == leg) & (F.col("v") == F.lit(end)))
        # begin .. until: which of the paths into ``head`` are asked for; rank: the number of the first of them
        heads = total.select(F.col("v").alias("head"), number(first).alias("begin"), F.least("n", number(first + count)).alias("until"), number(first).alias("rank"), F.array("v").alias("path"))
        heads, last = heads.where("begin < until"), None
        for d in range(dist, 0, -1):
            layer = self.edges.layer(d).where(F.col("leg") == leg).withColumnRenamed("v", "head")
            into = layer.join(heads, "head")
            before = Window.partitionBy("path").orderBy("pred").rowsBetween(Window.unboundedPreceding, -1)
            into = into.withColumn("skip", F.coalesce(F.sum("n").over(before), number(0)).cast(COUNT))
            into = into.where((F.col("skip") < F.col("until")) & (F.col("skip") + F.col("n") > F.col("begin")))
            heads = into.select(
                F.col("pred").alias("head"),
                F.greatest(F.col("begin") - F.col("skip"), number(0)).cast(COUNT).alias("begin"),
                F.least(F.col("until") - F.col("skip"), F.col("n")).cast(COUNT).alias("until"),
                (F.col("rank") + F.greatest(F.col("skip") - F.col("begin"), number(0))).cast(COUNT).alias("rank"),
                F.concat(F.array("pred"), F.col("path")).alias("path"),
            )
            if d % UNROLLED == 1:
                heads = written(heads, "slice")
                release(last)
                last = heads
        return heads.select("rank", "path")

    def release(self) -> None:
        release(self.vertices.path, self.found.path if self.found is not None else None)


#: Layers that one plan unrolls before its rows are written.
UNROLLED = 4


def shortest_path_dag(edges: DataFrame | Adjacency, starts: list, ends: list | None = None, removed: DataFrame | None = None, max_layers: int | None = None) -> Dag:
    """Searches from all starts at once; a leg stops after the layer at which it meets its end.

    ``ends`` None: everything that can be reached. ``max_layers`` None: until no leg
    moves on; with a number, DepthReached is raised if a leg would go on and has an end.
    """
    spark, kind = _table(edges).sparkSession, _kind(edges)
    dag = Dag(edges, _Layers(spark, new_path(spark, "vertices"), f"leg int, v {kind}, n {COUNT}"), {}, ends or [], kind)
    dag.vertices.add(_starts(edges, starts).withColumn("n", F.lit(1).cast(COUNT)), 0)
    dist, size = 0, len(starts)
    while max_layers is None or dist < max_layers:
        frontier = dag.vertices.layer(dist)
        if dag.met:
            frontier = frontier.where(~F.col("leg").isin(list(dag.met)))
        ahead = _ahead(edges, frontier, size)
        if not isinstance(edges, Adjacency):
            ahead = ahead.distinct()
        # summed where the edges lie, then by vertex
        layer = _unseen(ahead.groupBy("leg", "v").agg(F.try_sum("n").cast(COUNT).alias("n")), dag.vertices.rows(), removed)
        dist += 1
        counted = Observation()  # counted while the layer is written; a task that runs twice does no harm to the answers
        hits = [F.max(F.when(hit, 1).otherwise(0)).alias(f"m{k}") for k, hit in enumerate(_is_end(dag.ends))]
        dag.vertices.add(layer.observe(counted, F.count("*").alias("n"), *hits), dist)
        found = counted.get
        size = found["n"]
        if not size:
            return dag
        dag.met |= {k: dist for k in range(len(dag.ends)) if found[f"m{k}"] and k not in dag.met}
        if ends is not None and len(dag.met) == len(ends):
            return dag
    if ends is not None:
        raise DepthReached(f"{max_layers} layers did not reach every end")
    return dag


def bfs_layers(edges: DataFrame | Adjacency, start: object, removed: DataFrame | None = None, max_layers: int | None = None) -> DataFrame:
    """(v, dist) for every vertex that can be reached; with ``max_layers``, those at most so many edges away. Predecessors are not kept."""
    visited = _visited(_table(edges).sparkSession, _kind(edges))
    visited.add(_starts(edges, [start]), 0)
    dist, size = 0, 1
    while size and (max_layers is None or dist < max_layers):
        counted = Observation()
        layer = _step(edges, visited.layer(dist), visited.rows(), removed, size)
        dist += 1
        visited.add(layer.observe(counted, F.count("*").alias("n")), dist)
        size = counted.get["n"]
    return visited.rows().select("v", F.col("dist").cast("long").alias("dist"))


def _no_paths(edges: DataFrame | Adjacency, leg: bool = False) -> DataFrame:
    return _table(edges).sparkSession.createDataFrame([], f"{'leg long, ' if leg else ''}path array<{_kind(edges)}>")


def all_shortest_paths(
    edges: DataFrame | Adjacency, start: object, end: object, removed: DataFrame | None = None, max_layers: int | None = None, dag: Dag | None = None
) -> DataFrame:
    """Every shortest path as an array of vertices, one row each; no row where there is none.

    ``removed`` (one column) names vertices that a path may start at but not enter.
    A path from a vertex to itself is that vertex alone, whatever else is true of it.
    ``dag`` is that of an earlier search from ``start`` with the same edges and
    ``removed`` that reached ``end``, or everything; the search is not done again then.
    """
    if start is None or end is None:
        return _no_paths(edges)
    if start == end:
        return _table(edges).sparkSession.createDataFrame([([end],)], f"path array<{_kind(edges)}>")
    if dag is not None:
        at = dag.distance(end)
        return _no_paths(edges) if at is None else dag.paths([end], {0: at}).select("path")
    dag = shortest_path_dag(edges, [start], [end], removed, max_layers)
    out = dag.paths().select("path")
    dag.release()  # what is left to be read are the written heads: the last layer is always written
    return out


def path_chain(edges: DataFrame | Adjacency, stops: list, removed: DataFrame | None = None, strategy: ShortestPathStrategy | None = None) -> DataFrame:
    """(leg, path): shortest paths between each stop and the next, legs counted from 0.

    All legs are searched together, layer by layer; with a ``strategy``, one after another by it.
    """
    legs = list(zip(stops, stops[1:]))
    out = _no_paths(edges, leg=True)
    if strategy is not None:
        for leg, (a, b) in enumerate(legs):
            out = out.unionByName(strategy(edges, a, b, removed).select(F.lit(leg).cast("long").alias("leg"), "path"))
        return out
    same = [(leg, [a]) for leg, (a, b) in enumerate(legs) if a is not None and a == b]
    if same:
        out = _table(edges).sparkSession.createDataFrame(same, out.schema)
    apart = [(leg, a, b) for leg, (a, b) in enumerate(legs) if a is not None and b is not None and a != b]
    if not apart:
        return out
    dag = shortest_path_dag(edges, [a for _, a, _ in apart], [b for _, _, b in apart], removed)
    if dag.met:
        number = F.create_map(*[F.lit(x).cast("long") for k, (leg, _, _) in enumerate(apart) for x in (k, leg)])
        out = out.unionByName(dag.paths().select(number[F.col("leg")].alias("leg"), "path"))
    dag.release()
    return out


def paths_between_titles(edges: DataFrame | Adjacency, pages: DataFrame, start: str, end: str, strategy: ShortestPathStrategy = all_shortest_paths) -> DataFrame:
    """By title; none where a title is unknown. Removed pages are not entered."""
    from linkloom.operators.graph import last_by_title

    found = last_by_title(pages.where(F.col("title").isin(start, end))).select("title", "path").collect()  # two rows at most
    paths = {r.title: r.path for r in found}
    removed = pages.where("is_removed").select("path") if "is_removed" in pages.columns else None
    return strategy(edges, paths.get(start), paths.get(end), removed)


def bidirectional_paths(edges: DataFrame | Adjacency, start: object, end: object, removed: DataFrame | None = None, max_layers: int | None = None) -> DataFrame:
    """The same answer, searched from both ends: the smaller frontier moves on, until they meet.

    On graphs whose layers grow fast this visits the square root of what one
    direction visits.
    """
    table, kind = _table(edges), _kind(edges)
    spark = table.sparkSession
    if start is None or end is None or start == end:
        return all_shortest_paths(edges, start, end, removed)
    if removed is not None:
        removed = written(removed.toDF("v").distinct(), "removed")
        if not removed.where(F.col("v") == F.lit(end)).isEmpty():
            return _no_paths(edges)
    # going back, the start may be left although it is removed
    barred = [removed, None if removed is None else removed.where(F.col("v") != F.lit(start))]
    turned = table.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    graphs = [edges, turned]
    sides = [_visited(spark, kind) for _ in range(2)]
    for side, v in zip(sides, (start, end)):
        side.add(_starts(edges, [v]), 0)
    depth, sizes = [0, 0], [1, 1]
    while True:
        if max_layers is not None and sum(depth) >= max_layers:
            raise DepthReached(f"{max_layers} layers did not reach the end")
        s = 0 if sizes[0] <= sizes[1] else 1
        counted = Observation()
        layer = _step(graphs[s], sides[s].layer(depth[s]), sides[s].rows(), barred[s], sizes[s])
        other = sides[1 - s].layer(depth[1 - s]).withColumn("other", F.lit(1))
        met = layer.join(other, ["leg", "v"], "left").observe(counted, F.count("*").alias("n"), F.count("other").alias("met"))
        depth[s] += 1
        sides[s].add(met, depth[s])
        sizes[s] = counted.get["n"]
        if not sizes[s]:
            release(sides[0].path, sides[1].path, removed)
            return _no_paths(edges)
        if counted.get["met"]:
            break
    middle = sides[0].layer(depth[0]).join(sides[1].layer(depth[1]), ["leg", "v"], "left_semi")
    paths, last = middle.select("leg", F.col("v").alias("head"), F.col("v").alias("tail"), F.array("v").alias("path")), None
    for s in (0, 1):
        at, whole = ("head", lambda p: F.concat(F.array("v"), p)) if s == 0 else ("tail", lambda p: F.concat(p, F.array("v")))
        kept = "tail" if s == 0 else "head"
        for d in range(depth[s] - 1, -1, -1):
            back = _table(graphs[s]).join(paths, F.col("dst") == F.col(at)).select("leg", F.col("src").alias("v"), kept, "path")
            back = back.join(sides[s].layer(d), ["leg", "v"], "left_semi")
            paths = written(back.select("leg", F.col("v").alias(at), kept, whole(F.col("path")).alias("path")).distinct(), "heads")
            release(last)
            last = paths
    release(sides[0].path, sides[1].path, removed)
    return paths.select("path")
