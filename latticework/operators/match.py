"""All matches of a query: one row (m0, m1, ...) per way to map its vertices, one to one, so that labels are equal
and every query edge is a data edge. More edges between the data vertices do no harm unless ``induced``.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from itertools import permutations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from latticework.graph import Graph
from latticework.operators.blocks import triangles_by_blocks
from latticework.operators.prune import SPREAD, Steps, alike, apart, by_neighbour_labels, label_candidates, labelled_edges, live_edges, prune, prune_by_labels, spread
from latticework.plans import constraints as order_of
from latticework.plans.pattern import Pattern, Walk
from latticework.session import cut, stored


#: A pruning round that kills a smaller part of the vertices costs more than it saves; matches are the same.
LEAST_GAIN = 0.1

#: Edges of all steps of a query that may be sent to every task, so that rows need not be moved to them.
HELD = 1_000_000

#: Before rows become more than so many they are dealt out a last time, if they are enough to keep all tasks busy.
DEALT, ENOUGH = 2_000_000, 1_000


def enumerate_matches(edges: DataFrame, cand: DataFrame, p: Pattern, order: Sequence[int], parents: Mapping[int, int | None] | None = None, watch: Callable[[int, DataFrame], DataFrame] | None = None, symmetric: bool = True, holds: int | None = None) -> DataFrame:
    """A left-deep join along the order: the matched neighbour with the fewest edges expands, the others check by semi-join.

    Only vertices of equal labels can be the same one, so only these are told apart. A query with automorphisms is
    matched once for all of them: the data vertices of some pairs must be in order of (degree, id), which also keeps
    hubs from expanding where the query allows it, and the other matches are made of these at the end. parents: the
    neighbour that expands for each vertex. watch: sees the rows of each step. symmetric: whether vertices that
    automorphisms map to each other have the same candidates, but for some that are in no match. Before a row could
    become more than SPREAD rows in one task, the rows are dealt out anew. Where all steps can be held by every task
    (holds: as many edges, else HELD), that ends before rows become more than DEALT, so that only few are ever moved.
    """
    ranked = p.asymmetry() if symmetric else []
    rows, done, growth, made, last = None, [], 1, 0, False  # made: rows at most; last: dealt for the last time
    plan = list(zip(order, order_of.extensions(p, order)))
    steps = Steps(edges, cand, [(w, u) for u, before in plan for w in before], ranked, None not in p.labels, HELD if holds is None else holds)
    near = {frozenset(e) for e in p.edges}
    loose = [(a, b) for a, b in ranked if frozenset((a, b)) not in near]  # pairs that no step compares
    compared = {x for pair in loose for x in pair}
    for u, before in plan:
        if rows is None:
            rows = cand.where(F.col("u") == u).select(F.col("v").alias(f"m{u}"))
        elif not before:
            raise ValueError("the query is not connected")
        else:
            first = parents[u] if parents and parents.get(u) is not None else min(before, key=lambda w: (steps.sizes.get((w, u), 0), w))
            start = len(done) == 1 and first in compared
            step = steps.of(first, u, f"m{first}", f"m{u}", (f"d{first}" if start else "", f"d{u}" if u in compared else ""))
            most = steps.most.get((first, u), 1)
            growth *= most
            ahead = made * most if len(done) > 1 else steps.sizes.get((first, u), 0)
            if len(done) > 1 and steps.held and not last and ahead > DEALT:
                made, ahead = steps.ahead(rows, first, u)
                if made >= ENOUGH and ahead > DEALT:
                    rows, growth, last = spread(rows), 1, True
            if len(done) > 1 and growth > SPREAD:
                rows, growth = apart(rows) if last else spread(rows), most
            growth, made = max(growth, most), ahead
            rows = rows.join(step, f"m{first}")
            for w in before:
                if w != first:
                    rows = rows.join(steps.of(w, u, f"m{w}", f"m{u}"), [f"m{w}", f"m{u}"], "left_semi")
            for w in done:
                if w not in before and alike(p, w, u):
                    rows = rows.where(F.col(f"m{w}") != F.col(f"m{u}"))
            for a, b in loose:
                if u in (a, b) and {a, b} <= {*done, u}:
                    rows = rows.where(F.struct(f"d{a}", f"m{a}") < F.struct(f"d{b}", f"m{b}"))
            if watch:
                rows = watch(u, rows)
        done.append(u)
    columns = [f"m{u}" for u in range(p.n)]
    if not ranked:
        return rows.select(*columns)
    each = F.explode(F.array(*(F.struct(*(F.col(f"m{g[u]}").alias(f"m{u}") for u in range(p.n))) for g in p.automorphisms())))
    return rows.select(each.alias("x")).select("x.*")


def enumerate_by_walk(edges: DataFrame, cand: DataFrame, p: Pattern, start: int = 0) -> DataFrame:
    """The same rows by one walk over all query edges: each step finds a new vertex or checks an edge."""
    walk = p.covering_walk(start) if p.n > 1 else [0]
    rows, done = cand.where(F.col("u") == walk[0]).select(F.col("v").alias(f"m{walk[0]}")), [walk[0]]
    first = {frozenset(s): s for s in reversed(list(zip(walk, walk[1:])))}
    steps = Steps(edges, cand, list(first.values()))
    for a, b in zip(walk, walk[1:]):
        if first.pop(frozenset((a, b)), None) is None:
            continue
        step = steps.of(a, b, f"m{a}", f"m{b}")
        if b in done:
            rows = rows.join(step, [f"m{a}", f"m{b}"], "left_semi")
        else:
            rows = rows.join(step, f"m{a}")
            for w in done:
                if w != a and alike(p, w, b):
                    rows = rows.where(F.col(f"m{w}") != F.col(f"m{b}"))
            done.append(b)
    return rows.select(*(f"m{u}" for u in range(p.n)))


#: Neighbours of one vertex that stand in one array when arrays are intersected.
BLOCK = 4096


def enumerate_by_intersection(edges: DataFrame, cand: DataFrame, p: Pattern, order: Sequence[int]) -> DataFrame:
    """The same rows by intersecting the neighbour arrays of all matched neighbours of the next vertex.

    Cyclic queries then make no rows that a later edge would drop. Neighbours are put in blocks by a hash, so many that
    a hub's arrays hold about BLOCK of them each, and arrays meet within their block.
    """
    rows, done = None, []
    plan = list(zip(order, order_of.extensions(p, order)))
    steps = Steps(edges, cand, [(w, u) for u, before in plan for w in before])
    most = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    blocks = -(-most // BLOCK)
    for u, before in plan:
        if rows is None:
            rows = cand.where(F.col("u") == u).select(F.col("v").alias(f"m{u}"))
        else:
            lists = []
            for w in before:
                near = steps.of(w, u, f"m{w}", f"m{u}").withColumn("block", F.pmod(F.xxhash64(f"m{u}"), F.lit(blocks)))
                near = near.groupBy(f"m{w}", "block").agg(F.collect_list(f"m{u}").alias(f"near{w}"))
                rows = rows.join(near, [f"m{w}", "block"] if lists else [f"m{w}"])
                lists.append(F.col(f"near{w}"))
            both = reduce(F.array_intersect, lists)
            same = [F.col(f"m{w}") for w in done if w not in before and alike(p, w, u)]
            both = F.array_except(both, F.array(*same)) if same else both
            rows = rows.select(*(f"m{w}" for w in done), F.explode(both).alias(f"m{u}"))
        done.append(u)
    return rows.select(*(f"m{u}" for u in range(p.n)))


def only_induced(matches: DataFrame, edges: DataFrame, cand: DataFrame, p: Pattern) -> DataFrame:
    """Matches without a data edge where the query has none.

    Only edges between candidates can be such, and only those are written, once for all pairs.
    """
    missing = [(a, b) for a in range(p.n) for b in range(a + 1, p.n) if b not in p.neighbours(a)]
    if missing:
        steps = Steps(edges, cand, missing)
        for a, b in missing:
            if steps.sizes.get((a, b)):
                matches = matches.join(steps.of(a, b, f"m{a}", f"m{b}"), [f"m{a}", f"m{b}"], "left_anti")
    return matches.select(*(f"m{u}" for u in range(p.n)))


def label_counts_of(graph: Graph, p: Pattern) -> dict[int, int]:
    """The number of data vertices with each of the query's labels."""
    wanted = [x for x in set(p.labels) if x is not None]
    return {r.label: r.n for r in graph.label_histogram().where(F.col("label").isin(wanted)).collect()}


def degree_tail(graph: Graph, degrees: Sequence[int]) -> DataFrame:
    """(degree, n): how many vertices have at least each of these degrees."""
    ends = graph.vertex_table().groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.broadcast(graph.lines.sparkSession.createDataFrame([(d,) for d in sorted(set(degrees))], "at_least long"))
    both = wanted.join(ends, F.col("degree") >= F.col("at_least"), "left")
    return both.groupBy(F.col("at_least").alias("degree")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def label_rarity(graph: Graph, p: Pattern) -> list[float]:
    """The probability that a random vertex has a query vertex's label times that it has at least its degree."""
    at_least = {r.degree: r.n for r in degree_tail(graph, [p.degree(u) for u in range(p.n)]).collect()}
    return order_of.rarity(p, label_counts_of(graph, p), at_least, graph.vertices.count())


def _any_triangle(graph: Graph) -> DataFrame:
    """The matches of a triangle without labels."""
    pairs = stored(graph.pairs)
    found = triangles_by_blocks(pairs, pairs.count(), None if graph._vertices is None else graph.vertices)
    each = F.explode(F.array(*(F.struct(*(F.col(c).alias(f"m{i}") for i, c in enumerate(x))) for x in permutations("abc"))))
    return found.select(each.alias("x")).select("x.*")


def match(
    graph: Graph, p: Pattern, *, pruning: bool = True, walks: Sequence[Walk] = (), order: str | Sequence[int] = "size", strategy: str = "join",
    induced: bool = False, multigraph: bool = False, candidate_filter: Callable[[DataFrame], DataFrame] | None = None, report: dict | None = None,
) -> DataFrame:
    """The matches of p.

    order: "size" (by the candidates left), "vf3", or the query vertices as given. strategy: "join", "walk" or
    "intersect". walks: constraints to prune by, from plans.constraints. candidate_filter: may drop candidates (v, u)
    by other means, at the risk of matches. report: gets sizes and seconds, and under ``states`` an observation for
    each step of a join with the rows it made, to be read after the matches were. The query must be connected.
    """
    if not p.n:
        raise ValueError("the query has no vertex")
    if p.directed:
        raise ValueError("directed queries can be pruned by, not matched")
    if not p.connected():
        raise ValueError("the query is not connected")
    if p.n == len(p.edges) == 3 and set(p.labels) == {None} and isinstance(order, str) and strategy == "join" and graph.undirected and candidate_filter is None and report is None:
        return _any_triangle(graph)
    began = time.perf_counter()
    if pruning:
        cand, edges, counts = prune(graph, p, walks, multigraph, least_gain=LEAST_GAIN)
    else:
        cand, edges, counts = label_candidates(graph.vertices, p), labelled_edges(graph, p).select("src", "dst"), {}
        cand, edges = cut(cand), cut(edges)
    if candidate_filter:
        cand = cut(candidate_filter(cand))
    sizes = {r.u: r.n for r in cand.groupBy("u").agg(F.count(F.lit(1)).alias("n")).collect()}
    parents = None
    if isinstance(order, str):
        by_ties = order == "vf3"
        order = order_of.vf3_order(p, label_rarity(graph, p)) if order == "vf3" else order_of.size_order(p, sizes)
        parents = order_of.parents(p, order) if by_ties else None
    if report is not None:
        report |= counts | {"seconds_pruning": time.perf_counter() - began, "candidates": sizes, "order": list(order)}
        report |= {"vertices": graph.vertices.count(), "edges": graph.simple.count(), "live_vertices": cand.select("v").distinct().count(), "live_edges": live_edges(edges, cand).count()}
    if strategy == "walk":
        out = enumerate_by_walk(edges, cand, p, order[0])
    elif strategy == "intersect":
        out = enumerate_by_intersection(edges, cand, p, order)
    elif strategy == "join":
        states: dict[int, Observation] = {}

        def watch(u: int, rows: DataFrame) -> DataFrame:
            states[u] = Observation(f"rows with query vertex {u}")
            return rows.observe(states[u], F.count(F.lit(1)).alias("rows"))

        out = enumerate_matches(edges, cand, p, order, parents, None if report is None else watch, candidate_filter is None)
        if report is not None:
            report["states"] = states
    else:
        raise ValueError(strategy)
    return only_induced(out, graph.simple, cand, p) if induced else out


def is_in(graph: Graph, p: Pattern, near: Sequence[int] = (), simple: DataFrame | None = None) -> bool:
    """Whether p has a match. near: vertices that are tried first: a match among them is one, and only where they have
    none the whole graph is matched, all of whose matches are far more than is asked for. simple: the graph's edges."""
    if near:
        edges = graph.simple if simple is None else simple
        inside = edges.where(F.col("src").isin(*near) & F.col("dst").isin(*near)).select("src", "dst")
        if not match(Graph(stored(inside), graph.vertices.where(F.col("id").isin(*near)), graph.undirected), p).isEmpty():
            return True
    return not match(graph, p).isEmpty()


def match_many(graph: Graph, patterns: Mapping[int, Pattern]) -> DataFrame:
    """(query_no, m0, m1, ...): the matches of several queries, pruned together; null for vertices a query hasn't."""
    cand, edges, _ = prune_by_labels(graph, patterns, least_gain=LEAST_GAIN)
    sizes = {(r.q, r.u): r.n for r in cand.groupBy("q", "u").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns = [f"m{u}" for u in range(max(p.n for p in patterns.values()))]
    parts, holds = [], HELD // len(patterns)
    for q, p in patterns.items():
        if not p.connected():
            raise ValueError("the query is not connected")
        if any((q, u) not in sizes for u in range(p.n)):
            continue
        here = F.col("q") == q
        found = enumerate_matches(edges.where(here).drop("q"), cand.where(here).drop("q"), p, order_of.size_order(p, {u: sizes[q, u] for u in range(p.n)}), holds=holds)
        parts.append(found.select(F.lit(q).alias("query_no"), *(F.col(c) if int(c[1:]) < p.n else F.lit(None).cast("long").alias(c) for c in columns)))
    if not parts:
        return graph.lines.sparkSession.createDataFrame([], ", ".join(["query_no int", *(f"{c} long" for c in columns)]))
    return reduce(DataFrame.unionByName, parts)


def match_edited(graph: Graph, p: Pattern, k: int = 1, **how) -> DataFrame:
    """(prototype, m0, ...): the matches of every connected query that lacks k of p's edges."""
    parts = [match(graph, q, **how).select(F.lit(i).alias("prototype"), *(f"m{u}" for u in range(p.n))) for i, q in enumerate(p.prototypes(k))]
    if not parts:
        raise ValueError("no connected query is left")
    return reduce(DataFrame.unionByName, parts)


def matches_per_vertex(matches: DataFrame) -> DataFrame:
    """(u, v, n): in how many matches v stands for query vertex u."""
    names = [c for c in matches.columns if c.startswith("m")]
    each = F.explode(F.array(*(F.struct(F.lit(int(c[1:])).alias("u"), F.col(c).alias("v")) for c in names)))
    return matches.select(each.alias("x")).groupBy("x.u", "x.v").agg(F.count(F.lit(1)).alias("n"))


@contextmanager
def time_limit(spark: SparkSession, seconds: float, group: str = "latticework") -> Iterator[None]:
    """Jobs started inside are cancelled after so many seconds, and TimeoutError is raised; rows are never cut short."""
    sc, late = spark.sparkContext, threading.Event()
    sc.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)

    def cancel() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, cancel)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"not done after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    if late.is_set():
        raise TimeoutError(f"not done after {seconds} s")


__all__ = [
    "by_neighbour_labels", "enumerate_by_intersection", "enumerate_by_walk", "enumerate_matches", "is_in", "label_rarity", "match", "match_edited",
    "matches_per_vertex", "only_induced", "time_limit",
]
