"""Triangles, cores and trusses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.graph import Graph
from latticework.session import counted, cut, stored


def _both(pairs: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select(F.explode(ends).alias("e")).select("e.src", "e.dst")


def pair_degrees(pairs: DataFrame) -> DataFrame:
    """(id, d): each vertex's number of different neighbours."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))


def oriented(pairs: DataFrame, min_degree: int = 1) -> DataFrame:
    """(lo, hi): each pair from its end with the smaller (degree, id) to the other; ends below min_degree are left out.

    No vertex has more than about the square root of the number of edges going out, however large its degree.
    """
    deg = pair_degrees(pairs).where(F.col("d") >= min_degree)
    da, db = deg.select(F.col("id").alias("a"), F.col("d").alias("da")), deg.select(F.col("id").alias("b"), F.col("d").alias("db"))
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    both = pairs.join(da, "a").join(db, "b")
    return both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi"))


def wedges(dod: DataFrame) -> DataFrame:
    """(a, b, c): pairs of oriented edges a->b, a->c with b < c."""
    x, y = dod.select(F.col("lo").alias("a"), F.col("hi").alias("b")), dod.select(F.col("lo").alias("a"), F.col("hi").alias("c"))
    return x.join(y, "a").where("b < c")


def triangles(pairs: DataFrame) -> DataFrame:
    """(a, b, c): every triangle once; a is its vertex with the smallest (degree, id), b < c."""
    dod = cut(oriented(pairs, 2))
    close = dod.select(F.least("lo", "hi").alias("b"), F.greatest("lo", "hi").alias("c"))
    return wedges(dod).join(close, ["b", "c"], "left_semi").select("a", "b", "c")


def triangle_count(graph: Graph) -> DataFrame:
    """One row (wedges, triangles)."""
    dod = cut(oriented(graph.pairs, 2))
    out = dod.groupBy("lo").agg(F.count(F.lit(1)).alias("d"))
    n = out.select((F.col("d") * (F.col("d") - 1) / 2).cast("long").alias("wedges"), F.lit(0).cast("long").alias("triangles"))
    close = dod.select(F.least("lo", "hi").alias("b"), F.greatest("lo", "hi").alias("c"))
    t = wedges(dod).join(close, ["b", "c"], "left_semi").agg(F.count(F.lit(1)).alias("triangles"))
    both = n.unionByName(t.select(F.lit(0).cast("long").alias("wedges"), "triangles"))
    return both.agg(F.sum("wedges").alias("wedges"), F.sum("triangles").alias("triangles"))


def _sides(x: str, y: str, z: str):
    """The three sides of a triangle, each with its smaller end first."""
    side = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    return F.explode(F.array(side(x, y), side(x, z), side(y, z)))


def edge_triangles(pairs: DataFrame) -> DataFrame:
    """(a, b, n): each pair and the number of triangles it is in; their sum is three times the triangles."""
    sides = triangles(pairs).select(_sides("a", "b", "c").alias("e"))
    n = sides.groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(n, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def triangle_statistics(graph: Graph) -> DataFrame:
    """One row: pairs, triangles, closing_edges (pairs in a triangle), max_per_edge, closing_share."""
    pairs = graph.pairs
    s = edge_triangles(pairs).agg(
        F.count(F.lit(1)).alias("pairs"), F.expr("coalesce(sum(n), 0) div 3").alias("triangles"),
        F.count(F.when(F.col("n") > 0, 1)).alias("closing_edges"), F.max("n").alias("max_per_edge"),
    )
    return s.withColumn("closing_share", F.when(F.col("pairs") > 0, F.col("closing_edges") / F.col("pairs")))


def core(pairs: DataFrame, k: int) -> DataFrame:
    """(a, b): the pairs left when vertices with less than k neighbours are removed until there are none.

    Degrees are counted once. A round takes from them the edges of the vertices that fell below k in the last one;
    edges are partitioned once and never move again.
    """
    spark = pairs.sparkSession
    pairs = stored(pairs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = cut(_both(pairs).repartition(parts, "src"))
    degree = cut(both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")))
    while n := (weak := degree.where(F.col("d") < k).select(F.col("id").alias("src"))).count():
        lost = both.join(counted(weak, n), "src").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("lost"))
        degree = degree.where(F.col("d") >= k).join(lost, "id", "left")
        degree = cut(degree.select("id", (F.col("d") - F.coalesce("lost", F.lit(0))).alias("d")))
    left = degree.select("id")
    kept = pairs.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi")
    return stored(kept.select("a", "b"))


def core_vertices(graph: Graph, k: int) -> DataFrame:
    """(id, d): the vertices of the k-core and their degree in it."""
    return pair_degrees(core(graph.pairs, k))


class Supports:
    """The triangles on each pair of a graph, kept while pairs are taken away.

    Triangles are listed once. A round takes the pairs with too few, finds their triangles and subtracts these from
    their other sides; no triangle is looked for again.
    """

    def __init__(self, pairs: DataFrame, known: DataFrame | None = None):
        """known: the triangles (a, b, c), if they were listed before."""
        spark = pairs.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = (triangles(pairs) if known is None else known).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"))
        at = found.select(_sides("x", "y", "z").alias("e"), "x", "y", "z").select("e.a", "e.b", "x", "y", "z")
        self._at = cut(at.repartition(parts, "a", "b"))
        n = self._at.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        self.pairs = stored(pairs.join(n, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n")))
        self._gone = cut(self.pairs.select("a", "b").limit(0))
        self.rounds = 0

    def truss(self, k: int) -> DataFrame:
        """(a, b, n): what is left when pairs in less than k-2 triangles are taken away until there are none."""
        while n := (weak := self.pairs.where(F.col("n") < k - 2).select("a", "b")).count():
            self.rounds += 1
            hit = self._at.join(counted(weak, n), ["a", "b"]).select("x", "y", "z").distinct()
            for p, q in (("x", "y"), ("x", "z"), ("y", "z")):  # a triangle that lost a side before was subtracted then
                gone = self._gone.select(F.col("a").alias("lo"), F.col("b").alias("hi"))
                hit = hit.join(gone, (F.least(p, q) == F.col("lo")) & (F.greatest(p, q) == F.col("hi")), "left_anti")
            lost = hit.select(_sides("x", "y", "z").alias("e")).groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("lost"))
            left = self.pairs.where(F.col("n") >= k - 2).join(lost, ["a", "b"], "left")
            kept = stored(left.select("a", "b", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n")))
            self.pairs, self._gone = kept, cut(self._gone.unionByName(weak))
        return self.pairs

    def triangles(self) -> DataFrame:
        """(a, b, c): the triangles of which all sides are left."""
        sides = self._at.join(self.pairs, ["a", "b"], "left_semi").groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("sides"))
        return sides.where("sides = 3").select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("c"))


def truss(pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, n): the pairs left when those in less than k-2 triangles are removed until there are none."""
    return Supports(core(pairs, k - 1)).truss(k)  # what a truss keeps is in the core; peeling it first spares triangles


#: Triangles that one task may hold, at some 80 bytes each while they are numbered; more are peeled by joins.
AT_ONCE = 8_000_000

_LEVELS = "k int, edges long, vertices long, triangles long, dod_sources long"


def _ranks(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.searchsorted(known, x).astype(np.int32)


def _peel(k: int, k_max: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Levels from k on, of all triangles (a, b, c) in one task; a round goes over the triangles that are left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], []]
        for b in batches:
            for own, c in zip(columns, b.columns):
                own.append(c.to_numpy(zero_copy_only=False))
        corners = [np.concatenate(own) if own else np.zeros(0, np.int64) for own in columns]
        ids = np.unique(np.concatenate(corners))
        corners = [_ranks(ids, c) for c in corners]  # keeps the order of ids
        keys = [np.minimum(p, q).astype(np.int64) * len(ids) + np.maximum(p, q) for p, q in ((corners[0], corners[1]), (corners[0], corners[2]), (corners[1], corners[2]))]
        del columns, corners
        pairs = np.unique(np.concatenate(keys))
        sides = [_ranks(pairs, x) for x in keys]
        del keys
        ends, rows, level = (pairs // max(len(ids), 1), pairs % max(len(ids), 1)), [], k
        while k_max is None or level <= k_max:
            while True:
                n = sum(np.bincount(x, minlength=len(pairs)) for x in sides)
                kept = n >= level - 2
                whole = kept[sides[0]] & kept[sides[1]] & kept[sides[2]]
                if whole.all():
                    break
                sides = [x[whole] for x in sides]
            a, b = (x[kept] for x in ends)
            degree = np.bincount(np.concatenate([a, b]), minlength=len(ids))
            first = (degree[a] < degree[b]) | ((degree[a] == degree[b]) & (a < b))
            rows.append((level, len(a), int((degree > 0).sum()), len(sides[0]), len(np.unique(np.where(first, a, b)))))
            if not len(a):
                break
            level += 1
        types = (pa.int32(), *[pa.int64()] * 4)
        names = [x.split()[0] for x in _LEVELS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return run


def truss_levels(graph: Graph, k_max: int | None = None) -> DataFrame:
    """(k, edges, vertices, triangles, dod_sources) for k = 3, 4, ... until nothing is left (or k_max).

    While more than AT_ONCE triangles are left, a level is peeled by joins; what is left then is peeled in one task, where
    a round is no job.
    """
    spark = graph.lines.sparkSession
    rows, k, supports, left = [], 3, None, stored(triangles(graph.pairs))
    n = left.count()
    while n > AT_ONCE and (k_max is None or k <= k_max):
        supports = supports or Supports(core(graph.pairs, 2), left)
        t = supports.truss(k)
        pairs = t.select("a", "b")
        s = t.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        v = pair_degrees(pairs).count()
        rows.append((k, s[0], v, s[1] // 3, oriented(pairs).select("lo").distinct().count()))
        k, n, left = k + 1, s[1] // 3, None
    if not rows and not n:
        rows.append((k, 0, 0, 0, 0))
    elif (n or rows[-1][1]) and (k_max is None or k <= k_max):
        left = supports.triangles() if left is None else left
        rows += [tuple(r) for r in left.repartition(1).mapInArrow(_peel(k, k_max), _LEVELS).collect()] or [(k, 0, 0, 0, 0)]
    return spark.createDataFrame(rows, _LEVELS)
