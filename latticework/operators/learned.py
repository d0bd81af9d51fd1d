"""A learned filter for candidates: samples around vertices, a small graph network's inference, and its evaluation.

The filter may drop true matches, so nothing uses it unless it is passed to match(candidate_filter=...).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.bits import one_hot
from latticework.plans.pattern import Pattern
from latticework.session import stored

HOPS = 3


def clean_edges(edges: DataFrame) -> DataFrame:
    """(src, dst): both directions, no loops, no repetitions."""
    e = edges.where("src <> dst").select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
    return e.select("e.src", "e.dst").distinct()


#: Edges that every task holds while it searches around one centre after another; with more, neighbourhoods are found by joins.
HELD_EDGES = 2_000_000
#: Rows in one batch of a search's result.
BATCH = 100_000


def _searched(edges: DataFrame, centres: DataFrame, hops: int, inside: bool) -> DataFrame:
    """(v, id, hop), or inside: (v, src, dst), by a search around each centre over all edges, which are sent to every task.

    Nothing but the centres is shuffled, and a task holds one neighbourhood at a time.
    """
    spark = edges.sparkSession
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).toArrow()
    ends = np.stack([e.column(i).to_numpy() for i in (0, 1)]).astype(np.int64)
    ids, at = np.unique(ends, return_inverse=True)
    src, dst = at.reshape(ends.shape).astype(np.int32)
    by = np.argsort(src, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))]).astype(np.int64)
    sent = spark.sparkContext.broadcast((ids, starts, dst[by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, near = sent.value
        seen, first = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)

        def edges_of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The number of edges that go out from each of some, and where these go."""
            n = starts[some + 1] - starts[some]
            return n, near[np.repeat(starts[some] - np.cumsum(n) + n, n) + np.arange(n.sum())]

        def around(turn: int, centre: int) -> tuple[np.ndarray, np.ndarray]:
            i = np.searchsorted(ids, centre)
            if i == len(ids) or ids[i] != centre:  # without an edge
                return (np.zeros(0, np.int64),) * 2 if inside else (np.array([centre]), np.zeros(1, np.int32))
            front = np.array([i])
            seen[i], found = turn, [front]
            for _ in range(hops):
                _, to = edges_of(front)
                to = to[seen[to] != turn]
                first[to] = np.arange(len(to))
                front = to[first[to] == np.arange(len(to))]
                seen[front] = turn
                found.append(front)
            all_ = np.concatenate(found)
            if not inside:
                return ids[all_], np.repeat(np.arange(hops + 1, dtype=np.int32), list(map(len, found)))
            n, to = edges_of(all_)
            keep = seen[to] == turn
            return ids[np.repeat(all_, n)[keep]], ids[to[keep]]

        turn, held, n = 0, [], 0

        def batch() -> Iterator[pa.RecordBatch]:
            table = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["v", "src", "dst"] if inside else ["v", "id", "hop"])
            for i in range(0, table.num_rows, BATCH):
                yield table.slice(i, BATCH)

        for b in batches:
            for centre in b.column(0).to_pylist():
                a, c = around(turn, centre)
                turn += 1
                held.append((np.full(len(a), centre, np.int64), a, c))
                n += len(a)
                if n >= BATCH:
                    yield from batch()
                    held, n = [], 0
        if held:
            yield from batch()

    parts = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kinds = "v long, src long, dst long" if inside else "v long, id long, hop int"
    return centres.select(F.col("v").cast("long").alias("v")).where("v IS NOT NULL").distinct().repartition(parts, "v").mapInArrow(run, kinds)


def ego_nodes(edges: DataFrame, centres: DataFrame, hops: int = HOPS) -> DataFrame:
    """(v, id, hop): the vertices within so many hops of each centre(v), with their distance."""
    if edges.count() <= HELD_EDGES:
        return _searched(edges, centres, hops, inside=False)
    return _joined_nodes(edges, centres, hops)


def _joined_nodes(edges: DataFrame, centres: DataFrame, hops: int) -> DataFrame:
    found = front = centres.select("v", F.col("v").alias("id"), F.lit(0).alias("hop"))
    for h in range(1, hops + 1):
        near = front.join(edges.withColumnRenamed("src", "id"), "id").select("v", F.col("dst").alias("id")).distinct()
        front = near.join(found, ["v", "id"], "left_anti").withColumn("hop", F.lit(h))
        found = found.unionByName(front)
    return found


def edges_around(edges: DataFrame, centres: DataFrame, hops: int = HOPS) -> DataFrame:
    """(v, src, dst): the edges between the vertices within so many hops of each centre(v)."""
    if edges.count() <= HELD_EDGES:
        return _searched(edges, centres, hops, inside=True)
    return ego_edges(edges, _joined_nodes(edges, centres, hops))


def ego_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, src, dst): the edges within each centre's neighbourhood."""
    a = nodes.select("v", F.col("id").alias("src"))
    b = nodes.select("v", F.col("id").alias("dst"))
    return a.join(edges, "src").join(b, ["v", "dst"], "left_semi").select("v", "src", "dst")


def grown_samples(edges: DataFrame, centres: DataFrame, largest: int = 29, smallest: int = 3, seed: int = 0) -> DataFrame:
    """(v, id, full): a connected node set around each centre, of a random size; it grows by the neighbours with the smallest hashes.

    Every round adds to each set the not yet chosen neighbours, a third of its size at most, so all sets grow at once,
    until each has its size or no neighbour is left. full: whether it has; where whole sets are wanted, take these.

    Of a member with more than twice as many neighbours as a set can have, each set sees so many of them, from a place
    drawn by hash in a hashed order. More than it lacks are always new to it, so that sets become as large as with all.
    """
    size = (F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(largest - smallest + 1)) + smallest).alias("want")
    seen = 2 * largest
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "dst")
    near_of = stored(edges.select("src", "dst", (F.row_number().over(order) - 1).cast("long").alias("at"))).withColumn("block", F.expr(f"at div {seen}"))
    degree = stored(near_of.groupBy(F.col("src").alias("id")).agg((F.max("at") + 1).alias("n")))
    last = F.least(F.col("start") + seen, F.col("n")) - 1
    blocks = F.array(F.col("start"), last, F.when(F.col("start") + seen > F.col("n"), 0).otherwise(last))  # it goes on from the first
    blocks = F.array_distinct(F.transform(blocks, lambda x: F.floor(x / seen)))
    near_of = near_of.select(F.col("src").alias("id"), "dst", "at", "block")
    chosen = stored(centres.select("v", F.col("v").alias("id")).distinct())
    w = Window.partitionBy("v").orderBy(F.xxhash64(F.lit(seed), "v", "id"), "id")
    while True:
        have = chosen.groupBy("v").agg(F.count(F.lit(1)).alias("have")).select("v", "have", size)
        open_ = chosen.join(have.where("have < want"), "v").join(degree, "id")
        start = F.when(F.col("n") > seen, F.pmod(F.xxhash64(F.lit(seed), "v", "id"), F.col("n"))).otherwise(0)
        open_ = open_.withColumn("start", start.cast("long")).withColumn("block", F.explode(blocks))
        near = open_.join(near_of, ["id", "block"]).where(F.pmod(F.col("at") - F.col("start"), F.col("n")) < seen)
        near = near.select("v", F.col("dst").alias("id"), "have", "want").distinct().join(chosen, ["v", "id"], "left_anti")
        more = near.withColumn("r", F.row_number().over(w)).where("have + r <= want AND r <= greatest(1, want div 3)")
        more = stored(more.select("v", "id"))
        if more.isEmpty():
            return chosen.join(have.select("v", (F.col("have") == F.col("want")).alias("full")), "v").select("v", "id", "full")
        chosen = stored(chosen.unionByName(more))


#: Labels from which negative centres are drawn, one vertex each.
POOL = 256


def with_negatives(centres: DataFrame, vertices: DataFrame, seed: int = 0) -> DataFrame:
    """(v, other, positive): each centre with itself, and with a vertex of another label drawn by hash.

    Negatives come from a pool of one vertex for each of up to POOL labels, both drawn by hash; a centre that meets its
    own label takes the next of the pool. The pool is broadcast; no two tables are paired row by row.
    """
    drawn = vertices.groupBy("label").agg(F.min_by("id", F.struct(F.xxhash64(F.lit(seed), "id"), "id")).alias("other"))
    pool = drawn.orderBy(F.xxhash64(F.lit(seed), "label"), "label").limit(POOL).collect()
    v = centres.join(vertices.withColumnRenamed("id", "v"), "v")
    out = v.select("v", F.col("v").alias("other"), F.lit(True).alias("positive"))
    if len(pool) < 2:
        return out
    near = F.broadcast(vertices.sparkSession.createDataFrame([(i, r.label, r.other, pool[(i + 1) % len(pool)].other) for i, r in enumerate(pool)], "at int, its long, first long, second long"))
    neg = v.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), F.lit("pool"), "v"), F.lit(len(pool))).cast("int")).join(near, "at")
    other = F.when(F.col("label") == F.col("its"), F.col("second")).otherwise(F.col("first"))
    return out.unionByName(neg.select("v", other.alias("other"), F.lit(False).alias("positive")))


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def leaky(x: np.ndarray, slope: float = 0.1) -> np.ndarray:
    return np.where(x > 0, x, slope * x)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max()
    return x - np.log(np.exp(x).sum())


def _gather(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each node's sum over its incoming neighbours."""
    out = np.zeros_like(x)
    if len(edges):
        np.add.at(out, edges[:, 1], x[edges[:, 0]])
    return out


def _convolve(kind: str, x: np.ndarray, edges: np.ndarray, linear: Callable[[str, np.ndarray], np.ndarray]) -> np.ndarray:
    """One convolution. GIN: two linear maps of a node's state and its neighbours' sum. SAGE: a linear map of the
    neighbours' mapped sum beside the node's state. GCN: a linear map summed with both ends' degrees as norm."""
    if kind == "GIN":
        return linear("2", relu(linear("1", x + _gather(x, edges))))
    if kind == "SAGE":
        return linear("2", np.concatenate([_gather(linear("1", x), edges), x], axis=1))
    if kind == "GCN":
        own = np.arange(len(x))
        both = np.concatenate([edges, np.stack([own, own], axis=1)])
        norm = 1 / np.sqrt(np.bincount(both[:, 1], minlength=len(x)))[:, None]
        return linear("1", _gather(x * norm, both) * norm)  # mapped after the sum, which is the same
    raise ValueError(kind)


def graph_embedding(features: np.ndarray, edges: np.ndarray, weights: Mapping[str, np.ndarray], layers: int = 4, kind: str = "GIN", skip: str = "all") -> np.ndarray:
    """The sum-pooled embedding of one graph (features of its nodes; edges in both directions, no loops).

    A linear map, then layers of convolutions, each followed by a ramp; with skip "all" a layer sees the states of all
    layers before it side by side, with "learnable" each of them times the sigmoid of a weight, with "none" the last
    one. All states are summed over the nodes and pass a head of four linear maps with a leaky ramp and two ramps.

    weights: ``pre``, ``<layer>.1`` and ``<layer>.2``, ``post.1`` to ``post.4``, each as ``.w`` (inputs x outputs) and
    ``.b``; ``skip`` (layers x layers) if learnable.
    """
    def linear(name: str) -> Callable:
        return lambda x: x @ weights[f"{name}.w"] + weights[f"{name}.b"]

    edges = edges[edges[:, 0] != edges[:, 1]] if len(edges) else edges.reshape(0, 2)
    x = linear("pre")(features)
    seen = [x]
    for i in range(layers):
        if skip == "learnable":
            parts = [s / (1 + np.exp(-weights["skip"][i, k])) for k, s in enumerate(seen)]
        else:
            parts = seen if skip == "all" else seen[-1:]
        x = relu(_convolve(kind, np.concatenate(parts, axis=1), edges, lambda name, y: linear(f"{i}.{name}")(y)))  # noqa: B023
        seen.append(x)
    out = leaky(linear("post.1")(np.concatenate(seen, axis=1).sum(axis=0)))
    out = relu(linear("post.2")(out))
    return linear("post.4")(relu(linear("post.3")(out)))


def pair_probability(data: np.ndarray, query: np.ndarray, weights: Mapping[str, np.ndarray]) -> float:
    """The probability that the query's neighbourhood is contained in the data's, by a two-layer classifier."""
    x = relu(np.concatenate([data, query]) @ weights["mlp.1.w"] + weights["mlp.1.b"])
    return float(np.exp(log_softmax(x @ weights["mlp.2.w"] + weights["mlp.2.b"])[1]))


def weights_of_state(state: Mapping[str, np.ndarray], layers: int = 4, kind: str = "GIN") -> dict[str, np.ndarray]:
    """The weights above from the arrays of a trained model's saved state, by the state's own names."""
    # The names in a saved state.
    inner = {"GIN": ("nn.0", "nn.2"), "SAGE": ("lin", "lin_update"), "GCN": ("lin",)}[kind]
    names = {"pre": "emb_model.pre_mp.0", "mlp.1": "mlp.0", "mlp.2": "mlp.2"}
    names |= {f"post.{i + 1}": f"emb_model.post_mp.{at}" for i, at in enumerate((0, 3, 5, 7))}
    names |= {f"{i}.{k + 1}": f"emb_model.convs.{i}.{n}" for i in range(layers) for k, n in enumerate(inner)}
    out = {}
    for ours, theirs in names.items():
        out[f"{ours}.w"] = np.asarray(state[f"{theirs}.weight"]).T
        bias = f"{theirs}.bias" if f"{theirs}.bias" in state else f"{theirs.removesuffix('.lin')}.bias"
        out[f"{ours}.b"] = np.asarray(state[bias])
    if "emb_model.learnable_skip" in state:
        out["skip"] = np.asarray(state["emb_model.learnable_skip"])
    return out


def gin_score(weights: Mapping[str, np.ndarray], width: int, layers: int = 4, kind: str = "GIN", skip: str = "all", least_label: int = 0) -> Callable[[pd.DataFrame, pd.DataFrame, Pattern, int], float]:
    """score(nodes(id, label), edges(src, dst), pattern, u) by a network with these weights; a label is told to it as
    one of ``width``, counted from least_label."""
    def embed(labels: list[int], edges: list[tuple[int, int]]) -> np.ndarray:
        features = one_hot([x - least_label for x in labels], width)
        return graph_embedding(features, np.array(edges, dtype=np.int64).reshape(-1, 2), weights, layers, kind, skip)

    def score(nodes: pd.DataFrame, edges: pd.DataFrame, p: Pattern, u: int) -> float:
        at = {v: i for i, v in enumerate(nodes["id"])}
        data = embed(nodes["label"].tolist(), [(at[a], at[b]) for a, b in zip(edges["src"], edges["dst"])])
        near = [w for w, d in p.distances(u).items() if d <= HOPS]
        ids = {w: i for i, w in enumerate(near)}
        both = [(ids[a], ids[b]) for e in p.edges for a, b in (e, e[::-1]) if a in ids and b in ids]
        return pair_probability(data, embed([p.labels[w] for w in near], both), weights)

    return score


def learned_candidates(edges: DataFrame, vertices: DataFrame, cand: DataFrame, p: Pattern, score: Callable, least: float = 0.5) -> DataFrame:
    """The candidates (v, u) whose neighbourhood scores ``least`` or more against u's.

    Each candidate vertex's neighbourhood is gathered once and scored for all its query vertices. A task holds one
    neighbourhood and one batch of rows at a time: rows are sorted by the candidate and stream through it.
    """
    nodes = stored(ego_nodes(edges, cand.select("v").distinct()))
    row = lambda d, kind, a, b: d.select("v", F.lit(kind).alias("kind"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    rows = row(cand.select("v", "u").distinct(), 0, "u", "u").unionByName(row(nodes.join(vertices, "id"), 1, "id", "label"))
    rows = rows.unionByName(row(ego_edges(edges, nodes.select("v", "id")), 2, "src", "dst"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "v").sortWithinPartitions("v", "kind", "a", "b")

    def scored(v: int, r: np.ndarray) -> list[tuple[int, int]]:
        us, n, e = (r[r[:, 0] == kind, 1:] for kind in (0, 1, 2))
        n, e = pd.DataFrame(n, columns=["id", "label"]), pd.DataFrame(e, columns=["src", "dst"])
        return [(v, int(u)) for u in us[:, 0] if score(n, e, p, int(u)) >= least]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for b in batches:
            v, r = b["v"].to_numpy(), b[["kind", "a", "b"]].to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1), len(v)]
            out = []
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and v[i] != at:
                    out += scored(at, np.concatenate(held))
                    held = []
                at = int(v[i])
                held.append(r[i:j].copy())
            yield pd.DataFrame(out, columns=["v", "u"])
        if held:
            yield pd.DataFrame(scored(at, np.concatenate(held)), columns=["v", "u"])

    return rows.mapInPandas(run, "v long, u int")


def true_candidates(matches: DataFrame) -> DataFrame:
    """(v, u): every pair that is in a match."""
    each = F.explode(F.array(*(F.struct(F.col(c).alias("v"), F.lit(int(c[1:])).alias("u")) for c in matches.columns)))
    return matches.select(each.alias("x")).select("x.v", "x.u").distinct()


def evaluation(found: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """One row (tp, fp, fn, tn, precision, recall, accuracy) of candidate sets (v, u) within a universe of pairs."""
    mark = lambda d, name: d.select("v", "u").distinct().withColumn(name, F.lit(1))
    all_ = mark(universe, "all").join(mark(found, "f"), ["v", "u"], "left").join(mark(truth, "t"), ["v", "u"], "left")
    f, t = F.col("f").isNotNull(), F.col("t").isNotNull()
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    s = all_.agg(n(f & t, "tp"), n(f & ~t, "fp"), n(~f & t, "fn"), n(~f & ~t, "tn"))
    part = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return s.select("*", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def ranking_quality(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """One row (auroc, average_precision) of (score, positive) pairs; equal scores count half.

    Different scores are counted, range-partitioned and summed within their partition; a partition goes on from the
    totals of those before it. digits: scores are rounded first, where so many are not wanted.
    """
    score = F.col("score") if digits is None else F.round("score", digits).alias("score")
    by = scored.select(score.cast("double").alias("score"), F.col("positive").cast("long").alias("p")).groupBy("score")
    by = by.agg(F.sum("p").alias("p"), (F.count(F.lit(1)) - F.sum("p")).alias("q"))
    by = stored(by.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()))
    sums = {r.part: (r.p, r.q) for r in by.groupBy("part").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).collect()}  # one row a partition
    p = q = 0
    before = []
    for part in sorted(sums):
        before.append((part, p, q))
        p, q = p + sums[part][0], q + sums[part][1]
    up = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    c = by.join(F.broadcast(scored.sparkSession.createDataFrame(before, "part int, p0 long, q0 long")), "part")
    c = c.withColumn("tp", F.col("p0") + F.sum("p").over(up)).withColumn("fp", F.col("q0") + F.sum("q").over(up))
    none = F.lit(None).cast("double")
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)) / (float(p) * q) if p and q else none
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / p if p else none
    return c.agg(area.alias("auroc"), ap.alias("average_precision"))
