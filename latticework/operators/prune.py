"""Candidates for a query's vertices: which data vertices may stand for which query vertex.

A candidate table is (v, u). All filters here only drop candidates that are in no match, so they change how much
is joined later, never what comes out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.bits import bit_set, has_bit
from latticework.graph import Graph
from latticework.plans.pattern import Pattern, Walk
from latticework.session import counted, cut, stored


#: Rows that one row may become in a chain of broadcast joins. They are made by one task, which holds them all at once.
SPREAD = 10_000


def spread(rows: DataFrame) -> DataFrame:
    """The same rows, dealt to all tasks by hash, also those of one hub."""
    spark = rows.sparkSession
    n = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *rows.columns)


def apart(rows: DataFrame) -> DataFrame:
    """The same rows in the same tasks, but what follows takes them one by one from what makes them.

    Joins that Spark compiles together hold all rows that one row becomes in them; these are then compiled apart.
    """
    return rows.coalesce(1 << 20)


def _local(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of the query's size, which is what is broadcast here."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


class Steps:
    """The data edges that can stand for some of the query's edges, each in one direction.

    They are found by two joins for all of them together and written once, with the number of edges of each (sizes) and
    the most that go out from one vertex (most). ranked:
    pairs of query vertices of which the first one's data vertex must come before the second one's, by (degree, id) in
    ``edges``; steps between them are left out that don't, and rows can carry degrees to compare others. few: whether
    labels leave few of the edges; else they are written by columns. holds: as many edges may be sent to every task, if
    these are all steps together (held).
    """

    def __init__(self, edges: DataFrame, cand: DataFrame, steps: Sequence[tuple[int, int]], ranked: Sequence[tuple[int, int]] = (), few: bool = True, holds: int = 0):
        spark = edges.sparkSession
        wanted = _local(spark, sorted(set(steps)), "a int, b int")
        from_ = cand.select(F.col("v").alias("src"), F.col("u").alias("a")).join(wanted, "a")
        to = cand.select(F.col("v").alias("dst"), F.col("u").alias("b"))
        names = ["a", "b", "src", "dst"]
        if ranked:
            degree = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
            edges = edges.join(degree.select(F.col("id").alias("src"), F.col("d").alias("d_src")), "src")
            edges = edges.join(degree.select(F.col("id").alias("dst"), F.col("d").alias("d_dst")), "dst")
            names += ["d_src", "d_dst"]
        found = edges.join(from_, "src").join(to, ["dst", "b"]).select(*names)
        if ranked:
            up = F.struct("d_src", "src") < F.struct("d_dst", "dst")
            for first, second in ranked:
                a, b = F.col("a"), F.col("b")
                found = found.where(~((a == first) & (b == second)) | up).where(~((a == second) & (b == first)) | ~up)
        self._edges = (cut if few else stored)(found)
        each = self._edges.groupBy("a", "b", "src").agg(F.count(F.lit(1)).alias("k")).groupBy("a", "b")
        found = each.agg(F.sum("k").alias("n"), F.max("k").alias("most")).collect()
        self.sizes, self.most = ({(r.a, r.b): r[x] for r in found} for x in ("n", "most"))
        self.held = sum(self.sizes.values()) <= holds

    def of(self, a: int, b: int, left: str, right: str, degrees: Sequence[str] = ()) -> DataFrame:
        """(left, right): the edges for the query edge from a to b; degrees: names for those of both ends."""
        more = [F.col(c).alias(name) for c, name in zip(("d_src", "d_dst"), degrees) if name]
        some = self._edges.where((F.col("a") == a) & (F.col("b") == b)).select(F.col("src").alias(left), F.col("dst").alias(right), *more)
        return F.broadcast(some) if self.held else counted(some, self.sizes.get((a, b), 0))

    def ahead(self, rows: DataFrame, a: int, b: int) -> tuple[int, int]:
        """How many of the rows, which have m<a>, can take the step from a to b, and how many rows they become by it."""
        some = self._edges.where((F.col("a") == a) & (F.col("b") == b)).groupBy(F.col("src").alias(f"m{a}")).agg(F.count(F.lit(1)).alias("k"))
        found = rows.join(counted(some, self.sizes.get((a, b), 0)), f"m{a}").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k")).first()
        return found.n, found.k or 0


def label_candidates(vertices: DataFrame, p: Pattern) -> DataFrame:
    """(v, u): vertices with the label of a query vertex; a query vertex without a label takes all."""
    spark = vertices.sparkSession
    fixed = [(u, label) for u, label in enumerate(p.labels) if label is not None]
    free = [u for u, label in enumerate(p.labels) if label is None]
    v = vertices.select(F.col("id").alias("v"), "label")
    out = v.join(_local(spark, fixed, "u int, label long"), "label").select("v", "u")
    return out.unionByName(v.select("v", F.explode(F.array(*map(F.lit, free))).alias("u"))) if free else out


def label_counts(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, label, k): how many of src's neighbours have the label."""
    near = vertices.select(F.col("id").alias("dst"), "label")
    return edges.join(near, "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("k"))


def neighbour_counts(graph: Graph, multigraph: bool = False) -> DataFrame:
    """(src, label, k) over different neighbours; multigraph: over all edges, repeated ones and loops too."""
    return label_counts(graph.edges if multigraph else graph.simple, graph.vertices)


def _labelled(graph: Graph, patterns: Mapping[int, Pattern], multigraph: bool) -> DataFrame:
    """(q, src, dst, label of dst): for each query the edges whose two labels stand at one of its edges."""
    spark = graph.lines.sparkSession
    directed = any(p.directed for p in patterns.values())
    pairs, free = set(), []
    for q, p in patterns.items():
        ends = {(p.labels[a], p.labels[b]) for e in p.edges for a, b in ((e,) if directed else (e, e[::-1]))}
        if multigraph or any(x is None for pair in ends for x in pair):
            free.append(q)  # takes all edges
        else:
            pairs |= {(q, a, b) for a, b in ends}
    v = graph.vertices
    if not free:
        v = v.where(F.col("label").isin(sorted({x for _, *ends in pairs for x in ends}) or [-1]))
    e = graph.lines.select("src", "dst") if multigraph else graph.lines.where("src <> dst").select("src", "dst")
    e = e.join(v.select(F.col("id").alias("src"), F.col("label").alias("from_label")), "src")
    e = e.join(v.select(F.col("id").alias("dst"), "label"), "dst")
    if graph.undirected:  # turned only now, so that each line is moved once
        names = ["src", "dst", "from_label", "label"]
        turned = F.struct(*(F.col(c).alias(name) for c, name in zip(["dst", "src", "label", "from_label"], names)))
        e = e.select(F.explode(F.array(F.struct(*names), turned)).alias("e")).select("e.*")
    out = e.join(_local(spark, sorted(pairs), "q int, from_label long, label long"), ["from_label", "label"]) if pairs else None
    if free:
        all_ = e.withColumn("q", F.explode(F.array(*(F.lit(q) for q in free))))
        out = all_ if out is None else out.unionByName(all_)
    if out is None:
        out = e.limit(0).withColumn("q", F.lit(0))
    out = out.select("q", "src", "dst", "label")
    return out if multigraph or graph.once else out.distinct()  # after the labels, which leave few edges of a large graph


def labelled_edges(graph: Graph, p: Pattern, multigraph: bool = False) -> DataFrame:
    """(src, dst, label of dst): edges whose two labels stand at an edge of the query; all that a query can use."""
    return _labelled(graph, {0: p}, multigraph).drop("q")


def prune_by_labels(graph: Graph, patterns: Mapping[int, Pattern], multigraph: bool = False, max_rounds: int | None = None, least_gain: float = 0.0) -> tuple[DataFrame, DataFrame, int]:
    """(candidates (q, v, u), edges (q, src, dst), rounds) of several queries, numbered q, at once.

    v stays a candidate of u while it has at least as many live neighbours of every label as u has in the query; a
    vertex that is no candidate any more is dead for that query. Runs until no vertex dies, or for max_rounds, or until
    a round kills no more than ``least_gain`` of the vertices; stopping early keeps more, never less than all matches
    need. edges are those between live vertices (as of the last round but one, if stopped by its gain). multigraph:
    repeated edges and loops count too, which keeps more. A query of one vertex needs a label only. Directed queries
    are for a directed graph: what a vertex points to is counted. Where no neighbour has a label, nothing can die by it,
    and there is no round.
    """
    spark = graph.lines.sparkSession
    fixed = [(q, u, label) for q, p in patterns.items() for u, label in enumerate(p.labels) if label is not None]
    free = [(q, u) for q, p in patterns.items() for u, label in enumerate(p.labels) if label is None]
    v = graph.vertices.select(F.col("id").alias("v"), "label")
    cand = v.join(_local(spark, fixed, "q int, u int, label long"), "label").select("q", "v", "u")
    if free:
        any_ = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(u).alias("u")) for q, u in free))
        cand = cand.unionByName(v.select("v", F.explode(any_).alias("x")).select("x.q", "v", "x.u"))
    edges = stored(_labelled(graph, patterns, multigraph))
    need = [(q, *n) for q, p in patterns.items() for n in p.need()]
    wanted = _local(spark, need, "q int, u int, label long, k_min int")
    kinds = _local(spark, [(q, u, sum(n[:2] == (q, u) for n in need)) for q, p in patterns.items() for u in range(p.n)], "q int, u int, kinds long")
    cand, alive, rounds = cut(cand), None, 0
    while need and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        counts = edges.groupBy("q", F.col("src").alias("v"), "label").agg(F.count(F.lit(1)).alias("k"))
        met = counts.join(wanted, ["q", "label"]).where("k >= k_min").groupBy("q", "v", "u").agg(F.count(F.lit(1)).alias("met"))
        cand = cut(cand.join(met, ["q", "v", "u"], "left").join(kinds, ["q", "u"]).where(F.coalesce("met", F.lit(0)) >= F.col("kinds")).select("q", "v", "u"))
        live = cand.select("q", "v").distinct()
        n = live.count()
        if alive is not None and alive - n <= least_gain * alive:
            break
        alive = n
        for end in ("src", "dst"):
            edges = edges.join(counted(live.withColumnRenamed("v", end), n), ["q", end], "left_semi")
        edges = cut(edges.select("q", "src", "dst", "label"))  # few are left after the first round
    edges = edges.select("q", "src", "dst")
    return cand, edges.where("src <> dst").distinct() if multigraph else edges, rounds


def by_neighbour_labels(graph: Graph, p: Pattern, multigraph: bool = False, max_rounds: int | None = None, least_gain: float = 0.0) -> tuple[DataFrame, DataFrame, int]:
    """(candidates (v, u), edges (src, dst), rounds) of one query; see ``prune_by_labels``."""
    cand, edges, rounds = prune_by_labels(graph, {0: p}, multigraph, max_rounds, least_gain)
    return cand.drop("q"), edges.drop("q"), rounds


def prune_by_candidates(edges: DataFrame, cand: DataFrame, patterns: Mapping[int, Pattern], max_rounds: int | None = None) -> DataFrame:
    """Of several queries' candidates (q, v, u), those that for every neighbour of u have a neighbour that is its
    candidate, by the queries' edges (q, src, dst); until nothing changes."""
    spark = edges.sparkSession
    near = _local(spark, [(q, a, b) for q, p in patterns.items() for e in p.edges for a, b in (e, e[::-1])], "q int, u int, w int")
    degree = _local(spark, [(q, u, p.degree(u)) for q, p in patterns.items() for u in range(p.n)], "q int, u int, d int")
    n, rounds = cand.count(), 0
    while n and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        other = cand.select("q", F.col("v").alias("dst"), F.col("u").alias("w"))
        reach = edges.join(other, ["q", "dst"]).select("q", F.col("src").alias("v"), "w").distinct()
        reach = reach.join(near, ["q", "w"]).groupBy("q", "v", "u").agg(F.count(F.lit(1)).alias("n"))
        kept = cand.join(reach, ["q", "v", "u"], "left").join(degree, ["q", "u"]).where(F.coalesce("n", F.lit(0)) == F.col("d"))
        cand = cut(kept.select("q", "v", "u"))
        left = cand.count()
        if left == n:
            break
        n = left
    return cand


def by_neighbour_candidates(edges: DataFrame, cand: DataFrame, p: Pattern, max_rounds: int | None = None) -> DataFrame:
    """Candidates (v, u) of one query that for every neighbour of u have a neighbour that is its candidate."""
    q = F.lit(0).alias("q")
    return prune_by_candidates(edges.select(q, "src", "dst"), cand.select(q, "v", "u"), {0: p}, max_rounds).drop("q")


def live_edges(edges: DataFrame, cand: DataFrame) -> DataFrame:
    """The edges between vertices that are still candidates."""
    live = cand.select("v").distinct()
    out = edges.join(live.withColumnRenamed("v", "src"), "src", "left_semi")
    return out.join(live.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst")


def alike(p: Pattern, a: int, b: int) -> bool:
    return a != b and (p.labels[a] == p.labels[b] or None in (p.labels[a], p.labels[b]))


def walk_rows(edges: DataFrame, cand: DataFrame, w: Walk, p: Pattern, keep: Sequence[int] | None = None) -> DataFrame:
    """(m<u>, ...): all ways to take the walk. Positions with one query vertex are one data vertex, others differ.

    keep: only these query vertices' columns, each combination once. A column that no later step compares is then
    dropped as soon as it can be, and rows that are equal without it are one: what they can go on to is the same.
    Before a row could become more than SPREAD rows in one task, the rows are dealt out anew.
    """
    hops = list(zip(w.vertices, w.vertices[1:]))
    steps = Steps(edges, cand, hops)
    rows = cand.where(F.col("u") == w.vertices[0]).select(F.col("v").alias(f"m{w.vertices[0]}"))
    held, seen, growth = [w.vertices[0]], {w.vertices[0]}, 1
    for i, (a, b) in enumerate(hops):
        step = steps.of(a, b, f"m{a}", f"m{b}")
        if b in seen:
            rows = rows.join(step, [f"m{a}", f"m{b}"], "left_semi")
        else:
            growth *= steps.most.get((a, b), 1)
            if len(seen) > 1 and growth > SPREAD:
                rows, growth = spread(rows), steps.most.get((a, b), 1)
            rows = rows.join(step, f"m{a}")
            for c in held:
                if c != a and alike(p, c, b):
                    rows = rows.where(F.col(f"m{c}") != F.col(f"m{b}"))
            held.append(b)
            seen.add(b)
        if keep is not None:
            ahead = w.vertices[i + 2 :]
            new = [x for x in dict.fromkeys(ahead) if x not in seen]
            needed = {*keep, b, *(x for x in ahead if x in seen)} | {c for c in held for x in new if alike(p, c, x)}
            if dropped := [c for c in held if c not in needed]:
                held = [c for c in held if c not in dropped]
                rows = rows.select(*(f"m{c}" for c in held)).distinct()
    return rows.select(*(f"m{u}" for u in held)) if keep is None else rows.select(*(f"m{u}" for u in keep)).distinct()


def _only_ends_compared(w: Walk, p: Pattern) -> bool:
    """Whether the walk meets no query vertex twice and has no two positions, other than its ends, that could be one
    data vertex; the ends of an edge never are."""
    n = len(w.vertices)
    pairs = [(i, j) for i in range(n) for j in range(i + 2, n) if (i, j) != (0, n - 1)]
    return len(set(w.vertices)) == n > 2 and not any(alike(p, w.vertices[i], w.vertices[j]) for i, j in pairs)


def _able(edges: DataFrame, cand: DataFrame, w: Walk, p: Pattern) -> DataFrame:
    """(v): the candidates of the walk's first vertex that can take it, each once.

    Where only the two ends are compared, each vertex on the way keeps the smallest and the largest end that it leads to:
    if there is an end other than the start, one of the two is. A step then makes no more rows than it has edges.
    """
    u = w.vertices[0]
    if not _only_ends_compared(w, p):
        return walk_rows(edges, cand, w, p, [u]).select(F.col(f"m{u}").alias("v"))
    hops = list(zip(w.vertices, w.vertices[1:]))
    steps = Steps(edges, cand, hops)
    ends = None
    for a, b in reversed(hops):
        step = steps.of(a, b, "v", "next")
        step = step.select("v", F.col("next").alias("low"), F.col("next").alias("high")) if ends is None else step.join(ends.withColumnRenamed("v", "next"), "next")
        ends = step.groupBy("v").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    if alike(p, u, w.vertices[-1]):
        ends = ends.where("low <> v OR high <> v")
    return ends.select("v")


def by_walk(edges: DataFrame, cand: DataFrame, w: Walk, p: Pattern) -> DataFrame:
    """Candidates without those of the walk's first vertex that can't take the walk."""
    u = w.vertices[0]
    able = _able(edges, cand, w, p).withColumn("u", F.lit(u))
    return cand.where(F.col("u") != u).unionByName(cand.where(F.col("u") == u).join(able, ["v", "u"], "left_semi"))


def failing(edges: DataFrame, cand: DataFrame, w: Walk, p: Pattern) -> DataFrame:
    """(v, u): the candidates that by_walk drops."""
    return cand.where(F.col("u") == w.vertices[0]).join(_able(edges, cand, w, p), "v", "left_anti")


def prune(graph: Graph, p: Pattern, walks: Sequence[Walk] = (), multigraph: bool = False, max_rounds: int | None = None, arc: bool = False, least_gain: float = 0.0) -> tuple[DataFrame, DataFrame, dict]:
    """(candidates, edges, counts) after the neighbour labels and every walk; arc: also the neighbours' candidates.

    Candidates only get fewer: after a walk that asks for it and dropped some, the neighbours' candidates are
    checked on what is left.
    """
    cand, edges, rounds = by_neighbour_labels(graph, p, multigraph, max_rounds, least_gain)
    if arc:
        cand = by_neighbour_candidates(edges, cand, p)
        edges = cut(live_edges(edges, cand))
    dropped = []
    for w in walks:
        before = cand.count()
        cand = cut(by_walk(edges, cand, w, p))
        dropped.append(before - cand.count())
        if dropped[-1]:
            if w.rerun:
                cand = by_neighbour_candidates(edges, cand, p)
            edges = cut(live_edges(edges, cand))
    return cand, edges, {"rounds": rounds, "dropped_by_walk": dropped}


def candidate_bits(cand: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, label, bits): each live vertex with the set of its query vertices as bits."""
    bits = cand.groupBy(F.col("v").alias("id")).agg(bit_set(F.col("u")).alias("bits"))
    return vertices.join(bits, "id")


def candidates_of_bits(bits: DataFrame, n: int) -> DataFrame:
    """(v, u): the candidates that vertices (id, bits) of a query of n vertices stand for."""
    each = bits.select(F.col("id").alias("v"), "bits", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("u"))
    return each.where(has_bit(F.col("bits"), F.col("u"))).select("v", "u")


def pruned_size(cand: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (vertices, edges)."""
    zero = F.lit(0).cast("long")
    v = cand.agg(F.count_distinct("v").alias("vertices")).withColumn("edges", zero)
    both = v.unionByName(edges.agg(F.count(F.lit(1)).alias("edges")).select(zero.alias("vertices"), "edges"))
    return both.agg(F.sum("vertices").alias("vertices"), F.sum("edges").alias("edges"))
