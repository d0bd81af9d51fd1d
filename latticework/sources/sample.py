"""Queries and samples drawn from a data graph by random walks."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.graph import Graph
from latticework.plans.constraints import generate
from latticework.plans.pattern import Pattern
from latticework.session import counted, stored
from latticework.sources.text import read_pruned

def sorted_edges(graph: Graph) -> DataFrame:
    """The graph's simple edges, written in order of src: a step of a walk reads the few blocks that hold a vertex."""
    return stored(graph.simple.repartitionByRange("src").sortWithinPartitions("src"))


def turned_edges(graph: Graph) -> DataFrame:
    """The simple edges of an undirected graph whose lines are stored: a step of a walk reads all pairs, which for a
    few walks is less work, and far less disk, than to sort them."""
    pairs = graph.pairs
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def _next(simple: DataFrame, v: int, walked: list[int], seed: int) -> int | None:
    """Of v's neighbours that weren't walked, the one with the smallest hash; all of them are looked at, in Spark."""
    near = simple.where((F.col("src") == v) & ~F.col("dst").isin(walked))
    return near.agg(F.min_by("dst", F.struct(F.xxhash64(F.lit(seed), F.lit(len(walked)), "dst"), "dst"))).first()[0]


def walk(graph: Graph, n: int, seed: int = 0, jump: bool = False, start: int | None = None, simple: DataFrame | None = None) -> list[int]:
    """n vertices of a self-avoiding random walk; fewer if it gets stuck, unless it may jump back to a walked vertex."""
    rng = random.Random(seed)
    simple = sorted_edges(graph) if simple is None else simple
    if start is None:
        start = simple.agg(F.min_by("src", F.struct(F.xxhash64(F.lit(seed), "src"), "src"))).first()[0]
        if start is None:
            return []
    path, at, closed = [start], start, set()
    while len(path) < n and len(closed) < len(path):
        found = _next(simple, at, path, seed)
        if found is not None:
            at = found
            path.append(at)
            continue
        closed.add(at)
        open_ = [v for v in path if v not in closed]
        if not jump or not open_:
            break
        at = rng.choice(open_)
    return path


def _cycle(graph: Graph, n: int, seed: int, simple: DataFrame) -> list[int]:
    """n vertices of a cycle, at least three; fewer if the walk that it begins with is on none.

    The last three (of a triangle the last one) are found by joins, not walked to: a walk in a large sparse graph hardly
    ever comes back by itself. Of those that close the walk, the ones with the smallest hash are taken.
    """
    path = walk(graph, max(n - 3, 1 + (n == 3)), seed, simple=simple)
    if len(path) < max(n - 3, 1 + (n == 3)):
        return path
    near = lambda v: simple.where((F.col("src") == v) & ~F.col("dst").isin(path)).select("dst")
    if n == 3:
        found = near(path[-1]).join(near(path[0]), "dst").agg(F.min_by("dst", F.struct(F.xxhash64(F.lit(seed), "dst"), "dst"))).first()[0]
        return path if found is None else [*path, found]

    def two_steps(v: int, name: str) -> DataFrame:
        """(dst, two vertices between v and dst): two are enough to have one that isn't the other side's."""
        first = near(v).withColumnRenamed("dst", "src")
        both = simple.join(counted(first, first.count()), "src").where(~F.col("dst").isin(path))
        by = F.struct(F.xxhash64(F.lit(seed), "src"), "src")
        return both.groupBy("dst").agg(F.min_by("src", by).alias(f"{name}0"), F.max_by("src", by).alias(f"{name}1"))

    ways = two_steps(path[-1], "b").join(two_steps(path[0], "d"), "dst")
    pairs = F.explode(F.array(*(F.struct(F.col(b).alias("b"), F.col("dst").alias("c"), F.col(d).alias("d")) for b, d in (("b0", "d0"), ("b0", "d1"), ("b1", "d0")))))
    ways = ways.select(pairs.alias("x")).where("x.b <> x.d").select("x.*")
    found = ways.agg(F.min_by(F.struct("b", "c", "d"), F.struct(F.xxhash64(F.lit(seed), "b", "c", "d"), "b", "c", "d"))).first()[0]
    return path if found is None else [*path, *found]


def sample_subgraph(graph: Graph, n: int = 50, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(vertices(id, label), edges(src, dst)): the subgraph that n walked vertices induce."""
    ids = walk(graph, n, seed, jump=True)
    some = graph.lines.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    return graph.vertices.join(F.broadcast(some), "id", "left_semi"), graph.induced(some).select("src", "dst").distinct()


def query(graph: Graph, n: int = 8, kind: str = "other", seed: int = 0, tries: int = 20, constrained: bool = True, simple: DataFrame | None = None) -> Pattern:
    """A query of n vertices that the graph has; see ``drawn``."""
    return drawn(graph, n, kind, seed, tries, constrained, simple)[0]


def drawn(graph: Graph, n: int = 8, kind: str = "other", seed: int = 0, tries: int = 20, constrained: bool = True, simple: DataFrame | None = None) -> tuple[Pattern, list[int]]:
    """A query of n vertices that the graph has, and the vertices that were walked for it, in the query's order.

    kind: "path" has the walk's edges, "cycle" also its closing edge, "tree" a spanning tree of the induced graph,
    "other" a tree and up to n more of its edges. constrained: only queries with a walk constraint. simple: the graph's
    ``sorted_edges`` or ``turned_edges``, where several queries are drawn.
    """
    simple = sorted_edges(graph) if simple is None else simple
    for t in range(tries):
        rng = random.Random(seed * 1000 + t)
        path = (_cycle if kind == "cycle" and n > 2 else walk)(graph, n, seed * 1000 + t, simple=simple)
        if len(path) < n:
            continue
        at = {v: i for i, v in enumerate(path)}
        some = graph.lines.sparkSession.createDataFrame([(v,) for v in path], "id long")
        near = F.broadcast(some.withColumnRenamed("id", "src"))
        induced = simple.where(F.col("src").isin(path)).join(near, "src").join(F.broadcast(some.withColumnRenamed("id", "dst")), "dst").where("src < dst").collect()
        induced = sorted({(min(at[r.src], at[r.dst]), max(at[r.src], at[r.dst])) for r in induced})
        if kind == "cycle" and (0, n - 1) not in induced:
            continue
        label = {r.id: r.label for r in graph.vertices.join(F.broadcast(some), "id", "left_semi").collect()}
        if len(label) < n:
            continue
        steps = [(i, i + 1) for i in range(n - 1)]
        if kind == "cycle":
            steps.append((0, n - 1))
        elif kind in ("tree", "other"):
            tree, inside = [], {0}
            while len(inside) < n:
                e = rng.choice([e for e in induced if (e[0] in inside) != (e[1] in inside)])
                tree.append(e)
                inside |= set(e)
            rest = [e for e in induced if e not in tree]
            steps = tree + (rng.sample(rest, min(len(rest), rng.randint(0, n))) if kind == "other" else [])
        elif kind != "path":
            raise ValueError(kind)
        p = Pattern.of([label[v] for v in path], steps)
        if not constrained or generate(p):
            return p, path
    raise LookupError(f"no {kind} of {n} vertices found in {tries} walks")


def graph_of_files(spark: SparkSession, path: str) -> Graph:
    """A graph from a file of ``v id label`` and ``e src dst`` lines, to draw queries from."""
    vertices, edges = read_pruned(spark, path)
    return Graph(edges, vertices.select("id", "label"))


def queries_from(graph: Graph, count: int, n: int = 8, kind: str = "other", seed: int = 0, first_number: int = 0) -> dict[int, Pattern]:
    """Several queries by number, going on after the ones there are."""
    simple = sorted_edges(graph)
    return {first_number + i: query(graph, n, kind, seed + i, simple=simple) for i in range(count)}
