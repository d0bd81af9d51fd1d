"""Breadth-first search, shortest paths, connected components, PageRank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.graph import Graph
from latticework.session import counted, cut, stored


def first_source(graph: Graph, source: int) -> int | None:
    """The smallest id from source on that has an edge."""
    return graph.edges.where(F.col("src") >= source).agg(F.min("src")).first()[0]


def _kept_by(df: DataFrame, key: str) -> DataFrame:
    """df partitioned by a key and written so: what is joined by the key comes to it, it doesn't move again."""
    return cut(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key))


def bfs(graph: Graph, source: int, advance: bool = True) -> DataFrame:
    """(id, level, parent) of each vertex that source reaches; parent is the smallest of the possible ones.

    advance: a source without edges is replaced by the next id with one. Each round joins the newest level with the
    edges; a vertex is expanded once. What is known is dropped: in an undirected graph only the last two levels can be
    neighbours of the newest, in a directed one all are looked up.
    """
    spark = graph.lines.sparkSession
    start = first_source(graph, source) if advance else source
    schema = "id long, level int, parent long"
    front = spark.createDataFrame([] if start is None else [(start, 0, start)], schema)
    if start is None:
        return front
    edges = _kept_by(graph.simple, "src")
    fronts, level, n = [front], 0, 1
    while n:
        level += 1
        near = counted(front.select(F.col("id").alias("src")), n)
        seen = edges.join(near, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        known = reduce(DataFrame.unionByName, (f.select("id") for f in (fronts[-2:] if graph.undirected else fronts)))
        front = cut(seen.join(known, "id", "left_anti").select("id", F.lit(level).alias("level"), "parent"))
        n = front.count()
        fronts.append(front)
    return reduce(DataFrame.unionByName, fronts)


#: Rounds after which the distances found since are put together with those before.
ROUNDS_APART = 8


def sssp(graph: Graph, source: int, advance: bool = True) -> DataFrame:
    """(id, distance) of each vertex that source reaches, over edges with a weight; weights must not be negative.

    Each round relaxes the edges of the vertices whose distance fell in the last one, and writes these only.
    """
    spark = graph.lines.sparkSession
    edges = graph.edges.where(F.col("weight").isNotNull() & (F.col("src") != F.col("dst")))
    edges = _kept_by(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "src")
    if (least := edges.agg(F.min("weight")).first()[0]) is not None and least < 0:
        raise ValueError("negative weight")
    start = edges.where(F.col("src") >= source).agg(F.min("src")).first()[0] if advance else source
    front = spark.createDataFrame([] if start is None else [(start, 0.0)], "id long, distance double")
    base, since, n = _kept_by(front, "id"), [], int(start is not None)
    while n:
        near = counted(front.select(F.col("id").alias("src"), "distance"), n)
        to = edges.join(near, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("offer"))
        to = to.join(base.withColumnRenamed("distance", "d0"), "id", "left").where(F.col("d0").isNull() | (F.col("offer") < F.col("d0")))
        if since:
            to = to.join(_shortest(since).withColumnRenamed("distance", "d1"), "id", "left").where(F.col("d1").isNull() | (F.col("offer") < F.col("d1")))
        front = cut(to.select("id", F.col("offer").alias("distance")))
        n = front.count()
        since.append(front)
        if len(since) == ROUNDS_APART:
            base, since = _kept_by(_shortest([base, *since]), "id"), []
    return _shortest([base, *since])


def _shortest(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.min("distance").alias("distance"))


def components(graph: Graph, edge: Column | None = None, vertex: Column | None = None) -> DataFrame:
    """(id, cc): each vertex with an edge, and the smallest id of its component.

    edge, vertex: conditions on (src, dst, weight) and (id, label) that edges and vertices must meet; a vertex that
    meets its condition but keeps no edge is its own component. Direction is ignored. In each round every component
    with a neighbour of smaller rank is hung on the one of smallest rank; paths to roots are shortened, and the edges
    between what is left go on. Ranks are ids, which is quick where most have a common neighbour, and in every fourth
    round hashes drawn anew: a component with a neighbour then has the smallest rank among them half the time at most,
    so components at least halve in four rounds on average, whatever the graph's shape. A path halves in a step.
    """
    lines = graph.lines
    ids = lines.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    if vertex is not None:
        keep = graph.vertices.where(vertex).select("id")
        ids = ids.join(keep, "id", "left_semi")
        lines = graph.induced(keep)
    if edge is not None:
        lines = lines.where(edge)
    pairs = stored(lines.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    label = cut(ids.select("id", F.col("id").alias("cc")))
    rounds = 0
    while not pairs.isEmpty():
        rounds += 1
        rank = lambda v: F.struct((F.lit(0) if rounds % 4 else F.xxhash64(F.lit(rounds), v)).alias("h"), v.alias("v"))  # noqa: B023, E731
        ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
        least = pairs.select(ends.alias("e")).select("e.x", rank(F.col("e.y")).alias("r")).groupBy("x").agg(F.min("r").alias("r"))
        up, moving = cut(least.select("x", F.when(F.col("r") < rank(F.col("x")), F.col("r.v")).otherwise(F.col("x")).alias("p"))), True
        while moving:  # every path to a root is halved until it has one step
            far = up.select(F.col("x").alias("p"), F.col("p").alias("q"))
            up = cut(up.join(far, "p").select("x", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            moving = not up.where("moved").isEmpty()
            up = up.drop("moved")
        label = cut(label.join(up, label.cc == up.x, "left").select("id", F.coalesce("p", "cc").alias("cc")))
        a = up.select(F.col("x").alias("a"), F.col("p").alias("pa"))
        b = up.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        moved = pairs.join(a, "a").join(b, "b").where("pa <> pb")
        pairs = stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    smallest = label.groupBy("cc").agg(F.min("id").alias("smallest"))
    return label.join(smallest, "cc").select("id", F.col("smallest").alias("cc"))


def component_sizes(cc: DataFrame) -> DataFrame:
    """(cc, n)"""
    return cc.groupBy("cc").agg(F.count(F.lit(1)).alias("n"))


def pagerank(graph: Graph, iterations: int = 1, damping: float | None = None, normalizer: str = "n") -> DataFrame:
    """(id, rank) after some steps over the raw edges: each vertex shares its rank among them.

    Without damping a step is the plain sum of what comes in. normalizer: ranks start at 1/n, or 1/max_id. Ends of
    edges that are no vertices count as vertices here. Vertices without an edge pass nothing on.
    """
    edges = graph.edges.select("src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    degree = graph.degrees().withColumnRenamed("id", "src")
    share = edges.join(degree, "src").select("src", "dst", (F.col("k") / F.col("degree")).alias("part"))
    if iterations > 1:
        share = _kept_by(share, "src")
    ids = cut(graph.vertices.select("id").unionByName(degree.select(F.col("src").alias("id"))).distinct())
    size = ids.agg(F.count(F.lit(1)) if normalizer == "n" else F.max("id")).first()[0] or 1
    rank = ids.select("id", F.lit(1.0 / size).alias("rank"))
    for _ in range(iterations):
        came = share.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("part")).alias("came"))
        into = F.coalesce("came", F.lit(0.0))
        new = into if damping is None else F.lit((1 - damping) / size) + F.lit(damping) * into
        rank = ids.join(came, "id", "left").select("id", new.alias("rank"))
        if iterations > 1:
            rank = cut(rank)
    return rank
