"""Queries that read all of their tables, over small tables written here, against plain Python."""

import random
from collections import Counter

from graphs import embeddings, random_graph
from latticework.plans.pattern import Pattern
from latticework.queries import graphs as Q


def rows(df):
    return sorted(map(tuple, df.collect()))


def write(spark, folder, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_part_graph_has_all_lines(spark, tmp_path):
    rng = random.Random(5)
    lines = [(o, rng.randrange(24), rng.choice("RAN")) for o in range(30) for _ in range(5)]
    labels = {p: p % 6 for p in range(24)}
    d = write(
        spark, tmp_path, lineitem=(lines, "l_orderkey long, l_partkey long, l_returnflag string"),
        part=([(p, f"type {x}") for p, x in labels.items()], "p_partkey long, p_type string"),
    )
    edges = sorted({(a, b) for o, a, _ in lines for p, b, _ in lines if o == p and a < b})
    assert rows(Q.parts(spark, d).pairs) == edges
    for name in ("edge", "path3", "triangle", "diamond"):
        want = embeddings(edges, labels, Q.SHAPES[name])
        assert want and rows(Q.QUERIES[f"match_{name}"](spark, d)) == want
    induced = embeddings(edges, labels, Q.SHAPES["path3"], induced=True)
    assert rows(Q.QUERIES["match_induced_path3"](spark, d)) == induced
    report = Q.QUERIES["match_report"](spark, d).first()
    assert (report.matches, report.edges) == (len(embeddings(edges, labels, Q.SHAPES["diamond"])), 2 * len(edges))


def domain_tables(spark, folder, patterns, edges, labels, cand=()):
    return write(
        spark, folder, edge_list=([(a, b, 1.0) for a, b in edges], "s long, t long, weight double"),
        vertex_label=([(v, x, None, None) for v, x in labels.items()], "a long, l long, set_at timestamp, gone_at timestamp"),
        pattern_v=([(n, u, x) for n, p in patterns.items() for u, x in enumerate(p.labels)], "query_no int, u int, label long"),
        pattern_e=([(n, a, b) for n, p in patterns.items() for a, b in p.edges], "query_no int, a int, b int"),
        cand=(list(cand), "query_no int, v long, u int"),
    )


#: Of pattern 1 the cycle of five, of 8 and 10 the patterns of seven vertices, over few labels.
GIVEN = {
    1: Pattern.of([0, 1, 2, 0, 1], [(0, 1), (0, 4), (1, 2), (2, 3), (3, 4)]),
    8: Pattern.of([0, 1, 2, 1, 0, 2, 1], [(0, 1), (1, 2), (1, 3), (1, 5), (1, 6), (2, 4)]),
    10: Pattern.of([0, 1, 1, 2, 0, 2, 0], [(0, 1), (0, 2), (0, 3), (0, 4), (1, 5), (2, 6), (5, 6)]),
}


def test_all_given_patterns_are_matched(spark, tmp_path):
    edges, labels = random_graph(3, n=14, m=60)
    d = domain_tables(spark, tmp_path, GIVEN, edges, labels)
    got = {}
    for n, *m in map(tuple, Q.QUERIES["match_given"](spark, d).collect()):
        got.setdefault(n, []).append(tuple(m))
    for n, p in GIVEN.items():
        want = embeddings(edges, labels, p)
        assert want and sorted(tuple(m[: p.n]) for m in got[n]) == want and all(set(m[p.n :]) <= {None} for m in got[n])
        if f"match_given{n}" in Q.QUERIES:
            assert rows(Q.QUERIES[f"match_given{n}"](spark, d)) == want


def test_candidates_of_all_patterns(spark, tmp_path):
    edges, labels = random_graph(3, n=14, m=60)
    stated = [(n, v, u) for n in GIVEN for v in (0, 5, 9) for u in (0, 2)] + [(1, None, 0)]
    d = domain_tables(spark, tmp_path, GIVEN, edges, labels, stated)
    by_label = {(n, v, u) for n, p in GIVEN.items() for u, x in enumerate(p.labels) for v in labels if labels[v] == x}
    said = {x for x in stated if x[1] is not None}
    assert rows(Q.QUERIES["stated_not_by_label"](spark, d)) == sorted(said - by_label)
    both = Counter((n, u) for n, _, u in said | by_label)
    assert rows(Q.QUERIES["candidate_union"](spark, d)) == sorted((*k, n) for k, n in both.items())
    got, arc = (set(rows(Q.QUERIES[name](spark, d))) for name in ("lcc_candidates", "lcc_arc"))
    matched = {(n, m[u], u) for n, p in GIVEN.items() for m in embeddings(edges, labels, p) for u in range(p.n)}
    assert matched and matched <= arc <= got <= by_label


def test_ego_networks_have_three_hops_and_their_edges(spark, tmp_path):
    path = Pattern.of([0, 1, 2, 3, 4, 5, 6], [(i, i + 1) for i in range(6)])
    edges = [(i, i + 1) for i in range(6)] + [(0, 7), (20, 21)]
    d = domain_tables(spark, tmp_path, {Q.BIG: path}, edges, {**{v: v for v in range(7)}, 7: 9, 20: 0, 21: 5})
    nodes = [(v, w, abs(v - w)) for v in range(7) for w in range(7) if abs(v - w) <= 3]
    assert rows(Q.QUERIES["ego_network"](spark, d)) == nodes
    near = {(v, w) for v, w, _ in nodes}
    inside = [(v, a, b) for v in range(7) for a in range(7) for b in (a - 1, a + 1) if (v, a) in near and (v, b) in near]
    assert rows(Q.QUERIES["ego_edges"](spark, d)) == inside
