import heapq
import itertools

import pytest

from graphs import MICRO, adjacency, graph, random_graph
from pyspark.sql import functions as F

from latticework.operators import dense, traverse


def d(df, key="id", value=None):
    return {r[key]: (r[value] if value else tuple(r)) for r in df.collect()}


def reach(near, s):
    seen, front = {s: 0}, [s]
    while front:
        front = [w for v in front for w in near.get(v, ()) if w not in seen and not seen.update({w: seen[v] + 1})]
    return seen


@pytest.mark.parametrize("seed", range(2))
def test_traversal(spark, seed):
    edges, labels = random_graph(seed, n=40, m=36)
    weights = [(i * 7 % 5) / 2 if i % 6 else None for i in range(len(edges))]
    g, near = graph(spark, edges, labels, weights), adjacency(edges)
    s = min(v for e in edges for v in e)
    level = reach(near, s) if s in near else {s: 0}
    b = traverse.bfs(g, s).collect()
    assert {r.id: r.level for r in b} == level
    assert all(r.parent == r.id if not r.level else r.parent == min(w for w in near[r.id] if level[w] == r.level - 1) for r in b)
    cc = d(traverse.components(g), value="cc")
    assert cc == {v: min(reach(near, v)) for v in {x for e in edges for x in e}}
    assert d(traverse.component_sizes(traverse.components(g)), "cc", "n") == {c: sum(x == c for x in cc.values()) for c in cc.values()}
    best, heap, cost = {}, [], {}
    for (a, b_), w in zip(edges, weights):
        if w is not None and a != b_:
            for x, y in ((a, b_), (b_, a)):
                cost[x, y] = min(cost.get((x, y), 9e9), w)
    start = min(x for x, _ in cost)
    heapq.heappush(heap, (0.0, start))
    while heap:
        dist, v = heapq.heappop(heap)
        if v not in best:
            best[v] = dist
            for (x, y), w in cost.items():
                if x == v and y not in best:
                    heapq.heappush(heap, (dist + w, y))
    assert d(traverse.sssp(g, 0), value="distance") == pytest.approx(best)


def test_long_path_component(spark):
    n = 300
    got = d(traverse.components(graph(spark, [(i, i + 1) for i in range(n)])), value="cc")
    assert set(got.values()) == {0} and len(got) == n + 1


def test_component_filters(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)], {0: 1, 1: 1, 2: 2, 3: 2}, [0.1, 0.9, 0.1])
    assert d(traverse.components(g, edge=F.col("weight") <= 0.5), value="cc") == {0: 0, 1: 0, 2: 2, 3: 2}
    assert d(traverse.components(g, vertex=F.col("label") == 2), value="cc") == {2: 2, 3: 2}


def test_sources_and_errors(spark):
    g = graph(spark, MICRO["two"], weights=[1.0, 2.0])
    assert d(traverse.bfs(g, 2), value="level") == {5: 0, 6: 1}
    assert traverse.bfs(g, 7).count() == 0 and traverse.bfs(g, 2, advance=False).collect()[0].id == 2
    assert traverse.sssp(g, 7).count() == 0
    with pytest.raises(ValueError):
        traverse.sssp(graph(spark, [(0, 1)], weights=[-1.0]), 0)
    empty = graph(spark, [])
    assert traverse.components(empty).count() == traverse.bfs(empty, 0).count() == traverse.pagerank(empty).count() == 0


def test_pagerank(spark):
    edges = [(0, 1), (0, 1), (1, 2), (2, 2)]
    g = graph(spark, edges, {0: 0, 1: 0, 2: 0, 3: 0})
    both = [x for a, b in edges for x in ((a, b), (b, a))]
    rank = {v: 0.25 for v in range(4)}
    for damping, rounds in ((None, 1), (0.85, 3)):
        r = dict(rank)
        for _ in range(rounds):
            out = {v: sum(r[a] / sum(x == a for x, _ in both) for a, b in both if b == v) for v in range(4)}
            r = out if damping is None else {v: (1 - damping) / 4 + damping * x for v, x in out.items()}
        assert d(traverse.pagerank(g, rounds, damping), value="rank") == pytest.approx(r)
    assert traverse.pagerank(g, normalizer="max_id").agg(F.sum("rank")).first()[0] == pytest.approx(1.0)


def triangles(near):
    return {t for t in itertools.combinations(sorted(near), 3) if all(b in near[a] for a, b in itertools.combinations(t, 2))}


@pytest.mark.parametrize("seed", range(2))
def test_triangles_cores_trusses(spark, seed):
    edges, labels = random_graph(seed, n=16, m=60)
    g, near = graph(spark, edges, labels), adjacency(edges)
    t = triangles(near)
    assert {tuple(sorted(r)) for r in dense.triangles(g.pairs).collect()} == t
    assert dense.triangle_count(g).first().triangles == len(t)
    per = {(r.a, r.b): r.n for r in dense.edge_triangles(g.pairs).collect()}
    assert per == {(a, b): sum({a, b} <= set(x) for x in t) for a in near for b in near[a] if a < b}
    s = dense.triangle_statistics(g).first()
    assert (s.triangles, s.closing_edges, s.max_per_edge) == (len(t), sum(n > 0 for n in per.values()), max(per.values()))
    for k in (2, 4, 6):
        left = {v: set(w) for v, w in near.items()}
        while any(len(w) < k for w in left.values()):
            gone = {v for v, w in left.items() if len(w) < k}
            left = {v: w - gone for v, w in left.items() if v not in gone}
        assert d(dense.core_vertices(g, k), value="d") == {v: len(w) for v, w in left.items()}
    for k in (3, 4, 5):
        e = {x for x in per}
        while True:
            n = {x: sum(tuple(sorted((x[0], w))) in e and tuple(sorted((x[1], w))) in e for w in near) for x in e}
            kept = {x for x in e if n[x] >= k - 2}
            if kept == e:
                break
            e = kept
        assert {(r.a, r.b) for r in dense.truss(g.pairs, k).collect()} == e


def test_micro(spark):
    assert dense.triangle_count(graph(spark, MICRO["triangle"])).first().triangles == 1
    assert dense.triangle_count(graph(spark, MICRO["square"])).first().triangles == 0
    assert dense.core_vertices(graph(spark, MICRO["square"]), 2).count() == 4
    assert dense.truss(graph(spark, MICRO["square"]).pairs, 3).count() == 0
    assert [tuple(r) for r in dense.truss_levels(graph(spark, MICRO["triangle"])).collect()] == [(3, 3, 3, 1, 2), (4, 0, 0, 0, 0)]
    assert tuple(dense.triangle_count(graph(spark, [])).first()) == (0, 0)


def test_degrees(spark):
    g = graph(spark, MICRO["multi"])
    assert g.edges.count() == 6 and g.simple.count() == 2 and g.pairs.count() == 1
    assert d(g.degrees(), value="degree") == {0: 2, 1: 4} and d(g.degrees(loops=False), value="degree") == {0: 2, 1: 2}
    assert d(g.degrees_in_out()) == {0: (0, 2, 0), 1: (1, 1, 3)}
    assert d(g.degree_histogram(), "degree", "n") == {2: 1, 4: 1}
    assert d(g.with_degree_labels().vertices, value="label") == {0: 2, 1: 3}
    assert graph(spark, MICRO["star"], undirected=False).simple.count() == 3
    s = g.statistics(hub_degree=3).first()
    assert (s.vertices, s.lines, s.edges, s.pairs, s.loops, s.max_degree, s.hubs, s.hub_edges) == (2, 3, 6, 1, 1, 4, 1, 4)
    assert graph(spark, []).statistics().first().vertices == 0
    assert sum(r.edges for r in g.balance().collect()) == 6
    more = graph(spark, MICRO["two"], {0: 5, 1: 5}).with_labels(spark.createDataFrame([(1, 7), (9, 8), (None, 3)], "id long, label long"))
    assert d(more.vertices, value="label") == {0: 5, 1: 7, 9: 8}


def test_truss_levels_take_few_jobs_and_are_the_same_by_joins(spark, monkeypatch):
    """What one task can hold needs no job a round; the switch to it changes nothing."""
    g = graph(spark, random_graph(9, n=12, m=75)[0])
    sc = spark.sparkContext
    sc.setJobGroup("levels", "levels")
    found = [tuple(r) for r in dense.truss_levels(g).collect()]
    jobs = len(sc.statusTracker().getJobIdsForGroup("levels"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 40 and len(found) > 3 and found[-1][1:] == (0, 0, 0, 0)
    monkeypatch.setattr(dense, "AT_ONCE", found[1][3])  # the first levels by joins, the others in one task
    assert [tuple(r) for r in dense.truss_levels(g).collect()] == found
    assert [tuple(r) for r in dense.truss_levels(graph(spark, [(0, 1)])).collect()] == [(3, 0, 0, 0, 0)]
