import time

import pytest
from pyspark.sql import functions as F

from graphs import MICRO, adjacency, embeddings, graph, random_graph
from latticework.operators import match as M
from latticework.operators import prune as P
from latticework.plans import constraints
from latticework.plans.pattern import Pattern, Walk

PATTERNS = {
    "edge": Pattern.of([0, 1], [(0, 1)]),
    "path": Pattern.of([0, 1, 0], [(0, 1), (1, 2)]),
    "triangle": Pattern.of([None, 1, None], [(0, 1), (1, 2), (0, 2)]),
    "cycle": Pattern.of([0, 1, 0, 2], [(0, 1), (1, 2), (2, 3), (0, 3)]),
    "branch": Pattern.of([0, 1, 2, 1], [(0, 1), (1, 2), (0, 3)]),
}


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", PATTERNS)
def test_like_brute_force(spark, name):
    p = PATTERNS[name]
    edges, labels = random_graph(len(name))
    g = graph(spark, edges, labels)
    want = embeddings(edges, labels, p)
    assert rows(M.match(g, p, pruning=False, order="vf3")) == want
    assert rows(M.match(g, p, pruning=False, induced=True)) == embeddings(edges, labels, p, induced=True)
    if name in ("triangle", "branch"):
        assert rows(M.match(g, p, pruning=False, strategy="walk")) == want
        assert rows(M.match(g, p, pruning=False, strategy="intersect")) == want


@pytest.mark.parametrize("name,multi", [("triangle", True), ("cycle", False)])
def test_pruning_changes_no_rows(spark, name, multi):
    p = PATTERNS[name]
    edges, labels = random_graph(len(name))
    got = M.match(graph(spark, edges, labels), p, walks=constraints.generate(p), multigraph=multi)
    assert rows(got) == embeddings(edges, labels, p)


@pytest.mark.parametrize("shape,edges,n", [("triangle", [(0, 1), (1, 2), (0, 2)], 6), ("triangle", [(0, 1), (1, 2)], 6), ("square", [(0, 1), (1, 2), (2, 3), (0, 3)], 8), ("multi", [(0, 1)], 2)])
def test_micro(spark, shape, edges, n):
    p = Pattern.of([0] * (1 + max(map(max, edges))), edges)
    assert M.match(graph(spark, MICRO[shape]), p).count() == n


def test_micro_star_and_induced(spark):
    g = graph(spark, MICRO["star"], {0: 1, 1: 2, 2: 2, 3: 2})
    p = Pattern.of([2, 1, 2], [(0, 1), (1, 2)])
    assert M.match(g, p).count() == 6
    assert rows(P.by_neighbour_labels(g, p)[0].where("u = 1")) == [(0, 1)]
    assert M.match(graph(spark, MICRO["triangle"]), Pattern.of([0, 0, 0], [(0, 1), (1, 2)]), induced=True).count() == 0


def test_single_vertex_missing_label_disconnected(spark):
    edges, labels = random_graph(2)
    g = graph(spark, edges, labels)
    one = Pattern.of([1], [])
    assert rows(M.match(g, one)) == [(v,) for v in sorted(labels) if labels[v] == 1]
    assert M.match(g, Pattern.of([0, 99], [(0, 1)])).count() == 0
    with pytest.raises(ValueError):
        M.match(g, Pattern.of([0, 1, 2], [(0, 1)]))
    assert M.match(graph(spark, [], {1: 0}), PATTERNS["edge"]).count() == 0


def test_nulls_and_extra_columns(spark):
    e = spark.createDataFrame([(1, 2, None, 5), (None, 2, 1.0, 5), (2, None, 1.0, 5), (2, 3, 1.0, 5)], "src long, dst long, weight double, label int")
    v = spark.createDataFrame([(1, 0, "x"), (2, 1, "x"), (3, 0, "x"), (None, 0, "x"), (2, 1, "y")], "id long, label long, u string")
    from latticework.graph import Graph

    assert rows(M.match(Graph(e, v), PATTERNS["path"])) == [(1, 2, 3), (3, 2, 1)]


def lcc(edges, labels, p, multigraph):
    """Candidates by neighbour labels, round by round."""
    both = [x for a, b in edges for x in ((a, b), (b, a))]
    if not multigraph:
        both = sorted({x for x in both if x[0] != x[1]})
    cand = {(v, u) for v in labels for u in range(p.n) if p.labels[u] == labels[v]}
    while True:
        alive = {v for v, _ in cand}
        k = {}
        for a, b in both:
            if a in alive and b in alive:
                k[a, labels[b]] = k.get((a, labels[b]), 0) + 1
        cand = {(v, u) for v, u in cand if all(k.get((v, label), 0) >= n for w, label, n in p.need() if w == u)}
        if {v for v, _ in cand} == alive:
            return cand


@pytest.mark.parametrize("seed", [2])
def test_pruning_like_brute_force(spark, seed):
    edges, labels = random_graph(seed, n=24, m=34)
    g, p = graph(spark, edges, labels), PATTERNS["cycle"]
    for multi in (False, True):
        assert set(rows(P.by_neighbour_labels(g, p, multi)[0])) == lcc(edges, labels, p, multi)
    cand, e, _ = P.by_neighbour_labels(g, p)
    arc = set(rows(P.by_neighbour_candidates(e, cand, p)))
    near, want = adjacency(edges), set(rows(cand))
    while True:
        kept = {(v, u) for v, u in want if all(any((x, w) in want for x in near.get(v, ())) for w in p.neighbours(u))}
        if kept == want:
            break
        want = kept
    assert arc == want
    truth = {(m[u], u) for m in embeddings(edges, labels, p) for u in range(p.n)}
    assert truth <= arc
    w = Walk((0, 1, 2, 3, 0), True)
    kept = set(rows(P.by_walk(e, cand, w, p)))
    assert truth <= kept <= set(rows(cand)) and {x for x in kept if x[1] == 0} == {x for x in truth if x[1] == 0}
    assert set(rows(P.failing(e, cand, w, p))) == set(rows(cand)) - kept


def test_directed_pruning(spark):
    p = Pattern.of([0, 1, 0], [(0, 1), (1, 2)], directed=True)
    g = graph(spark, [(1, 2), (2, 3), (5, 4), (6, 4), (4, 5)], {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1}, undirected=False)
    assert set(rows(P.by_neighbour_labels(g, p)[0])) == {(1, 0), (2, 1), (3, 2), (5, 0), (4, 1), (5, 2), (1, 2)}
    with pytest.raises(ValueError):
        M.match(g, p)


def test_a_round_limit_keeps_more(spark):
    edges, labels = random_graph(1, n=24, m=30)
    g, p = graph(spark, edges, labels), PATTERNS["cycle"]
    assert set(rows(P.by_neighbour_labels(g, p, max_rounds=1)[0])) >= set(rows(P.by_neighbour_labels(g, p)[0]))


def test_metamorphic(spark):
    edges, labels = random_graph(5)
    p = PATTERNS["path"]
    n = M.match(graph(spark, edges, labels), p, pruning=False).count()
    moved = M.match(graph(spark, [(a * 7 + 3, b * 7 + 3) for a, b in edges], {v * 7 + 3: x for v, x in labels.items()}), p, pruning=False).count()
    lonely = M.match(graph(spark, edges, labels | {999: 0}), p, pruning=False).count()
    assert n == moved == lonely >= M.match(graph(spark, edges[1:-2], labels), p, pruning=False).count()


def test_edited_per_vertex_report_and_bits(spark):
    edges, labels = random_graph(6)
    g, p = graph(spark, edges, labels), PATTERNS["cycle"]
    got = M.match_edited(g, p, 1, pruning=False).collect()
    for i, q in enumerate(p.prototypes(1)):
        assert sorted(tuple(r)[1:] for r in got if r.prototype == i) == embeddings(edges, labels, q)
    report = {}
    m = M.match(g, p, report=report, walks=constraints.generate(p))
    want = embeddings(edges, labels, p)
    per = {(r.u, r.v): r.n for r in M.matches_per_vertex(m).collect()}
    assert sum(per.values()) == p.n * len(want)
    assert report["vertices"] == len(labels) and report["live_vertices"] <= report["vertices"] and len(report["order"]) == p.n
    cand, e, _ = P.by_neighbour_labels(g, p)
    bits = {r.id: r.bits for r in P.candidate_bits(cand, g.vertices).collect()}
    assert bits == {v: sum(1 << u for x, u in map(tuple, cand.collect()) if x == v) for v in bits}
    size = P.pruned_size(cand, e).first()
    assert (size.vertices, size.edges) == (len(bits), e.count())


SYMMETRIC = {
    "triangle": Pattern.of([None] * 3, [(0, 1), (1, 2), (0, 2)]), "clique": Pattern.of([0] * 4, [(a, b) for a in range(4) for b in range(a + 1, 4)]),
    "square": Pattern.of([None] * 4, [(0, 1), (1, 2), (2, 3), (0, 3)]), "star": Pattern.of([1, None, None, None], [(0, 1), (0, 2), (0, 3)]),
    "path": Pattern.of([None] * 4, [(0, 1), (1, 2), (2, 3)]), "twins": Pattern.of([0, 1, 0, 1, 2], [(0, 1), (2, 3), (0, 4), (2, 4)]),
}


@pytest.mark.parametrize("name", SYMMETRIC)
@pytest.mark.parametrize("order", ["size", "vf3"])
def test_symmetric_queries(spark, name, order):
    """One match is found for all automorphisms and the others are made of it."""
    p = SYMMETRIC[name]
    edges, labels = random_graph(8, n=14, m=50)
    edges += [(13, i) for i in range(12)]
    want = embeddings(edges, labels, p)
    assert len(p.automorphisms()) > 1 and want
    report = {}
    m = M.match(graph(spark, edges, labels), p, order=order, report=report)
    assert rows(m) == want
    assert report["states"][report["order"][-1]].get["rows"] * len(p.automorphisms()) == len(want)
    kept = M.match(graph(spark, edges, labels), p, candidate_filter=lambda c: c.where("NOT (v = 13 AND u = 1)"))
    assert rows(kept) == [x for x in want if x[1] != 13]


def test_blocks_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 3)
    edges, labels = random_graph(8, n=14, m=50)
    edges += [(13, i) for i in range(12)]
    for p in SYMMETRIC.values():
        assert rows(M.match(graph(spark, edges, labels), p, strategy="intersect")) == embeddings(edges, labels, p)


@pytest.mark.parametrize("name", SYMMETRIC)
def test_induced_symmetric(spark, name):
    p = SYMMETRIC[name]
    edges, labels = random_graph(2, n=12, m=24)
    near = adjacency(edges)
    want = [m for m in embeddings(edges, labels, p) if all(m[b] not in near[m[a]] for a in range(p.n) for b in range(a) if b not in p.neighbours(a))]
    assert rows(M.match(graph(spark, edges, labels), p, induced=True)) == want


def test_walks_forget_what_nothing_compares(spark):
    """Rows that differ only in vertices no later step compares are one, and candidates stay those that can walk."""
    edges, labels = random_graph(3, n=30, m=90, labels=4)
    g = graph(spark, edges, labels)
    for p, w in ((Pattern.of([0, 1, 2, 3], [(0, 1), (1, 2), (2, 3), (0, 3)]), Walk((0, 1, 2, 3, 0), True)), (Pattern.of([0, 1, 0, 1], [(0, 1), (1, 2), (2, 3)]), Walk((0, 1, 2, 3), False))):
        cand, e, _ = P.by_neighbour_labels(g, p)
        all_ = P.walk_rows(e, cand, w, p)
        some = P.walk_rows(e, cand, w, p, [0])
        assert rows(some) == sorted({(r.m0,) for r in all_.collect()})
        assert some._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") > 1 or p.labels[2] == 0


def test_time_limit(spark):
    with pytest.raises(TimeoutError):
        with M.time_limit(spark, 0.5):
            spark.range(4).select(F.udf(lambda x: time.sleep(3) or 1, "int")("id")).collect()
    with M.time_limit(spark, 60):
        assert spark.range(3).count() == 3


def test_a_hubs_matches_are_made_by_many_tasks(spark):
    leaves = {v: 1 + v % 4 for v in range(1, 81)}
    p = Pattern.of([0, 1, 2, 3, 4], [(0, u) for u in range(1, 5)])
    found = M.match(graph(spark, [(0, v) for v in leaves], {0: 0, **leaves}), p)
    by_task = [r.n for r in found.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(by_task) == 20**4 and max(by_task) < 20**4 / 2
    assert found.distinct().count() == 20**4


def test_rows_are_moved_only_while_they_are_few(spark, monkeypatch):
    """However many rows each leaf makes of a hub, those dealt to all tasks are the few of the first leaves."""
    monkeypatch.setattr(M, "SPREAD", 100)
    monkeypatch.setattr(M, "DEALT", 10_000, raising=False)
    monkeypatch.setattr(M, "ENOUGH", 100, raising=False)
    leaves = {v: 1 + v % 4 for v in range(1, 161)}
    p = Pattern.of([0, 1, 2, 3, 4], [(0, u) for u in range(1, 5)])
    found = M.match(graph(spark, [(0, v) for v in leaves], {0: 0, **leaves}), p)
    assert found.agg(F.count(F.lit(1)), *(F.count_distinct(c) for c in found.columns)).first() == (40**4, 1, 40, 40, 40, 40)
    by_task = [r.n for r in found.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(by_task) == 40**4 and max(by_task) < 40**4 / 2
    found.write.format("noop").mode("overwrite").save()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    values, moved = store.executionMetrics(last.executionId()), 0
    for i in range(last.metrics().size()):
        m = last.metrics().apply(i)
        if m.name() == "shuffle records written" and values.contains(m.accumulatorId()):
            moved += int(values.apply(m.accumulatorId()).replace(",", ""))
    assert 100 <= moved <= 10_000


@pytest.mark.parametrize("name", ["cycle", "branch", "twins"])
def test_rows_dealt_a_last_time_are_all_rows(spark, monkeypatch, name):
    for k, n in (("SPREAD", 1), ("DEALT", 5), ("ENOUGH", 2)):
        monkeypatch.setattr(M, k, n)
    edges, labels = random_graph(4)
    p = {**PATTERNS, **SYMMETRIC}[name]
    assert rows(M.match(graph(spark, edges, labels), p)) == embeddings(edges, labels, p)
    for holds in (0, 10**6):
        cand, e, _ = P.by_neighbour_labels(graph(spark, edges, labels), p)
        assert rows(M.enumerate_matches(e, cand, p, constraints.size_order(p, {}), holds=holds)) == embeddings(edges, labels, p)


def test_paths_over_two_hubs_are_made_by_many_tasks(spark):
    labels = {0: 1, 1: 2, **{v: 3 for v in range(2, 302)}}
    p = Pattern.of([1, 2, 3, 3], [(0, 1), (0, 2), (1, 3)])
    g = graph(spark, [(0, 1), *((v % 2, v) for v in range(2, 302))], labels)
    found = M.match(g, p, walks=constraints.generate(p, counts=M.label_counts_of(g, p)))
    by_task = [r.n for r in found.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(by_task) == 150**2 and max(by_task) < 150**2 / 2


def test_no_round_of_pruning_where_no_neighbour_has_a_label(spark):
    edges, labels = random_graph(6)
    p = Pattern.of([None] * 3, [(0, 1), (1, 2), (0, 2)])
    g, report = graph(spark, edges, labels), {}
    assert rows(M.match(g, p, report=report)) == embeddings(edges, labels, p)
    assert report["rounds"] == 0


def two_hubs(leaves):
    """A path over two neighbouring hubs, from a leaf of one to a leaf of the other, and the rows that its walk can have."""
    p = Pattern.of([1, 2, 3, 3], [(0, 1), (0, 2), (1, 3)])
    labels = {0: 1, 1: 2, **{v: 3 for v in range(2, 2 + leaves)}}
    return p, [(0, 1), *((v % 2, v) for v in range(2, 2 + leaves))], labels


def test_a_walk_over_hubs_makes_no_more_rows_than_edges(spark):
    p, edges, labels = two_hubs(600)
    g = graph(spark, edges, labels)
    cand, e, _ = P.by_neighbour_labels(g, p)
    kept = P.by_walk(e, cand, Walk((2, 0, 1, 3), False), p)
    assert {r.v for r in kept.collect() if r.u == 2} == {v for v in range(2, 602) if v % 2 == 0}
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    values, most = store.executionMetrics(last.executionId()), 0
    for i in range(last.metrics().size()):
        m = last.metrics().apply(i)
        if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
            most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    assert 300 <= most <= 2 * len(edges)


def test_rows_of_a_walk_from_a_hub_are_made_by_many_tasks(spark):
    p = Pattern.of([0, 1, 2], [(0, 1), (0, 2)])
    g = graph(spark, [(0, v) for v in range(1, 301)], {0: 0, **{v: 1 + v % 2 for v in range(1, 301)}})
    cand, e, _ = P.by_neighbour_labels(g, p)
    found = P.walk_rows(e, cand, Walk((0, 1, 0, 2), False), p)
    by_task = [r.n for r in found.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(by_task) == 150**2 and max(by_task) < 150**2 / 2


def test_candidates_that_can_take_a_path(spark):
    """By the ends that a vertex leads to, as by all rows of the walk; also where an end can only be the start itself."""
    edges, labels = random_graph(1, n=16, m=24)
    edges += [(20, 21), (21, 22), (22, 20), (30, 31), (31, 32), (32, 30), (32, 33)]
    labels |= {20: 0, 21: 1, 22: 2, 30: 0, 31: 1, 32: 2, 33: 0}
    g = graph(spark, edges, labels)
    for p in (Pattern.of([0, 1, 2, 0], [(0, 1), (1, 2), (2, 3)]), Pattern.of([0, 1, 1, 0], [(0, 1), (1, 2), (2, 3)])):
        cand, e = P.label_candidates(g.vertices, p), P.labelled_edges(g, p).select("src", "dst")
        for w in (Walk((0, 1, 2, 3), False), Walk((3, 2, 1, 0), False)):
            u = w.vertices[0]
            able = {r[f"m{u}"] for r in P.walk_rows(e, cand, w, p).collect()}
            assert {v for v, x in rows(P.by_walk(e, cand, w, p)) if x == u} == able
            assert {v for v, _ in rows(P.failing(e, cand, w, p))} == {v for v, x in rows(cand) if x == u} - able
            if list(p.labels) == [0, 1, 2, 0] and u == 0:
                assert (20 in able, 30 in able) == (False, True)


@pytest.mark.parametrize("multi", [False, True])
def test_lines_stand_in_both_directions(spark, multi):
    lines = [(1, 2), (2, 1), (1, 2), (3, 3), (2, 3), (4, 1)]
    g = graph(spark, lines, {1: 0, 2: 1, 3: 1, 4: 5})
    both = [(a, b, {1: 0, 4: 5}.get(b, 1)) for x in lines for a, b in (x, x[::-1])]
    p = Pattern.of([0, 1, 1], [(0, 1), (1, 2)])
    assert rows(P.labelled_edges(g, p, multi)) == sorted(both if multi else {x for x in both if x[0] != x[1] and 4 not in x[:2]})
