"""Synthetic edges: R-MAT, Kronecker products, preferential attachment, dense triangles."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.bits import scramble_array, scramble_column
from latticework.session import cut

#: Graph500's quadrant weights.
QUADRANTS = (0.57, 0.19, 0.19, 0.05)
BLOCK = 1 << 16


def _rmat_block(scale: int, n: int, rng: np.random.Generator, weights: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    src, dst = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    share = np.tile(np.array(weights), (n, 1))
    for _ in range(scale):
        bounds = np.cumsum(share, axis=1)
        quadrant = (rng.random(n)[:, None] > bounds[:, :3]).sum(axis=1).astype(np.uint64)
        src = src << np.uint64(1) | quadrant >> np.uint64(1)
        dst = dst << np.uint64(1) | quadrant & np.uint64(1)
        share *= 0.9 + 0.2 * rng.random((n, 4))
        share /= share.sum(axis=1, keepdims=True)
    return src, dst


def rmat(spark: SparkSession, scale: int, edges: int, seed: int = 5489, scramble: bool = True, undirected: bool = False, weights: tuple[float, float, float, float] = QUADRANTS, first_block: int = 0) -> DataFrame:
    """(src, dst) of a recursive-matrix graph over 2**scale ids; repetitions and loops are kept.

    Every block of edges has its own seeded generator, so the edges don't depend on the partitions. Ids are
    scrambled by a permutation, which needs 17 bits or more; smaller graphs keep theirs.
    """
    blocks = -(-edges // BLOCK)
    scramble = scramble and scale >= 17

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block in b["id"]:
                n = min(BLOCK, edges - block * BLOCK)
                src, dst = _rmat_block(scale, n, np.random.default_rng([seed, first_block + block]), weights)
                if scramble:
                    src, dst = scramble_array(src, scale), scramble_array(dst, scale)
                yield pd.DataFrame({"src": src.astype(np.int64), "dst": dst.astype(np.int64)})

    out = spark.range(blocks).mapInPandas(run, "src long, dst long")
    return out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if undirected else out


def rmat_unique(spark: SparkSession, scale: int, edges: int | None = None, seed: int = 5489) -> DataFrame:
    """(a, b) with a < b: exactly ``edges`` (16 * 2**scale by default) different pairs, no loops.

    Batches are generated until there are enough; of the surplus, pairs with the largest hashes are left out.
    """
    edges = edges or 16 << scale
    if edges > (1 << scale) * ((1 << scale) - 1) // 2:
        raise ValueError("there are not so many pairs")
    have, known, block = None, 0, 0
    while known < edges:
        more = max(edges - known, edges // 8)
        made = rmat(spark, scale, more, seed, first_block=block).where("src <> dst")
        made = made.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        block += -(-more // BLOCK)
        have = cut((made if have is None else have.unionByName(made)).distinct())
        known = have.count()
    if known == edges:
        return have
    at = F.xxhash64("a", "b")
    cells = {r.c: r.n for r in have.groupBy(F.shiftright(at, 44).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    kept, limit = 0, None
    for c in sorted(cells):
        if kept + cells[c] > edges:
            limit = c
            break
        kept += cells[c]
    low = have.where(F.shiftright(at, 44) < limit)
    return low.unionByName(have.where(F.shiftright(at, 44) == limit).orderBy(at, "a", "b").limit(edges - kept))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(src, dst): each pair (a, b) in both directions."""
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select(F.explode(ends).alias("e")).select("e.src", "e.dst")


def degree_checks(edges: DataFrame, hub_degree: int) -> DataFrame:
    """One row (ends, id_xor, hubs): checksums over both ends of all edges, and ids with that degree or more."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    by = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(
        F.sum("n").alias("ends"),
        F.bit_xor(F.when(F.col("n") % 2 == 1, F.col("id")).otherwise(F.lit(0))).alias("id_xor"), F.count(F.when(F.col("n") >= hub_degree, 1)).alias("hubs"),
    )


def kronecker(left: DataFrame, right: DataFrame, n_right: int, scramble_bits: int = 0) -> DataFrame:
    """(src, dst, weight): every pair of edges of two factors (src, dst, weight), weights multiplied.

    The product of all pairs is the result itself. The factor on the right is broadcast if Spark finds it small.
    """
    l, r = left.alias("l"), right.alias("r")
    at = lambda end: F.col(f"l.{end}") * F.lit(n_right) + F.col(f"r.{end}")
    out = l.crossJoin(r).select(at("src").alias("src"), at("dst").alias("dst"), (F.col("l.weight") * F.col("r.weight")).alias("weight"))
    if scramble_bits:
        out = out.withColumns({c: scramble_column(F.col(c), scramble_bits) for c in ("src", "dst")})
    return out


def coprime(m: int) -> int:
    """A factor without a divisor in common with m, so that multiplying permutes 0..m-1; its products fit in a long."""
    step = max(1, min(2_654_435_761, (1 << 62) // max(m, 1)))
    while gcd(step, m) > 1:
        step -= 1
    return step


def preferential(spark: SparkSession, vertices: int, per_vertex: int = 4, beta: float = 0.5, seed: int = 1, rewire: bool = False) -> DataFrame:
    """(src, dst): every new vertex sends ``per_vertex`` edges to older ones; with probability beta to the end of a
    random earlier edge (so, in proportion to degree), else to a random older vertex.

    Edge e leaves vertex e // per_vertex. A target that is the end of another edge points to that edge; pointers
    only point backwards and are resolved by pointer jumping in a logarithmic number of joins. rewire: the sources
    are shuffled by a permutation of the edges.
    """
    m = vertices * per_vertex
    e = spark.range(m).withColumnRenamed("id", "e")
    u = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "e"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    src = F.floor(F.col("e") / per_vertex)
    pick = F.floor(u(1) * F.col("e") * 2).cast("long")
    points = (u(2) < beta) & (F.col("e") >= per_vertex)
    e = e.select(
        "e", src.alias("src"),
        F.when(points & (pick % 2 == 1), F.floor(pick / 2)).alias("pointer"),
        F.when(points & (pick % 2 == 0), F.floor(F.floor(pick / 2) / per_vertex)).when(~points, F.floor(u(3) * F.greatest(src, F.lit(1)))).alias("dst"),
    )
    e = cut(e)
    while e.where("pointer IS NOT NULL").limit(1).count():
        to = e.select(F.col("e").alias("pointer"), F.col("pointer").alias("next"), F.col("dst").alias("found"))
        e = cut(e.join(to, "pointer", "left").select("e", "src", F.col("next").alias("pointer"), F.coalesce("dst", "found").alias("dst")))
    if rewire:
        step = coprime(m)
        other = e.select(F.pmod(F.col("e") * step + seed, F.lit(m)).alias("e"), F.col("src").alias("other"))
        e = e.join(other, "e").withColumn("src", F.col("other"))
    return e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


def upper_triangle(spark: SparkSession, edges: int) -> DataFrame:
    """(src, dst) with src <= dst, column by column, the first ``edges`` of them; no join, each from its number."""
    k = F.col("id")
    dst = F.floor((F.sqrt(F.lit(8.0) * k + 1) - 1) / 2).cast("long")
    dst = F.when(dst * (dst + 1) / 2 > k, dst - 1).when((dst + 1) * (dst + 2) / 2 <= k, dst + 1).otherwise(dst)
    return spark.range(edges).select((k - dst * (dst + 1) / 2).cast("long").alias("src"), dst.alias("dst"))
