import numpy as np
import pytest
from pyspark.sql import functions as F

from graphs import adjacency, graph, random_graph
from latticework.operators import learned as L
from latticework.operators import match as M
from latticework.operators import prune as P
from latticework.plans.pattern import Pattern

P3 = Pattern.of([0, 1, 0], [(0, 1), (1, 2)])


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ego(spark):
    edges, labels = random_graph(3, n=30, m=35)
    near = adjacency(edges)
    e = L.clean_edges(graph(spark, edges).lines)
    assert set(rows(e)) == {(a, b) for a in near for b in near[a]}
    c = spark.createDataFrame([(0,), (5,)], "v long")
    nodes = L.ego_nodes(e, c, 2)
    want = {}
    for v in (0, 5):
        hop = {v: 0}
        for h in (1, 2):
            for x in [x for x, d in hop.items() if d == h - 1]:
                for w in near.get(x, ()):
                    hop.setdefault(w, h)
        want |= {(v, x, d): 1 for x, d in hop.items()}
    assert set(rows(nodes)) == set(want)
    ids = {v: {x for a, x, _ in want if a == v} for v in (0, 5)}
    assert set(rows(L.ego_edges(e, nodes))) == {(v, a, b) for v in ids for a in near for b in near[a] if {a, b} <= ids[v]}


def test_samples(spark):
    edges, labels = random_graph(7, n=40, m=120)
    g = graph(spark, edges, labels)
    c = g.vertices.select(g.vertices.id.alias("v"))
    near, by, full = adjacency(edges), {}, {}
    for v, x, done in rows(L.grown_samples(g.simple, c, largest=9)):
        by.setdefault(v, set()).add(x)
        full[v] = done
    for v, some in by.items():
        assert v in some and len(some) <= 9
        seen, front = {v}, [v]
        while front:
            front = [w for x in front for w in near.get(x, ()) if w in some and w not in seen and not seen.add(w)]
        assert seen == some
        assert full[v] or all(w in some for x in some for w in near.get(x, ()))  # smaller only if nothing is left
    path = graph(spark, [(i, i + 1) for i in range(60)])
    assert all(r.full for r in L.grown_samples(path.simple, spark.createDataFrame([(i,) for i in range(0, 60, 7)], "v long")).collect())
    pairs = L.with_negatives(c, g.vertices).collect()
    assert all((r.v == r.other) == r.positive and (r.positive or labels[r.v] != labels[r.other]) for r in pairs)
    assert sum(r.positive for r in pairs) == len(labels)


def test_sets_that_meet_in_a_hub_take_a_part_of_its_neighbours(spark):
    """20,000 sets around a hub of as many grow to their size, and not always alike; all pairs of both would take minutes."""
    hub, n = 99_999, 20_000
    g = graph(spark, [(hub, i) for i in range(n)])
    with M.time_limit(spark, 90):
        found = L.grown_samples(g.simple, spark.range(n).withColumnRenamed("id", "v")).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("full").alias("full")).collect()
    assert len(found) == n and all(r.full and r.v in r.ids and hub in r.ids and 3 <= len(set(r.ids)) == len(r.ids) <= 29 for r in found)
    assert len({x for r in found for x in r.ids}) == n + 1 and len({frozenset({*r.ids} - {r.v}) for r in found}) > n // 2


def state(width, hidden=4, layers=2, seed=0, kind="GIN", skip="all"):
    """A saved state with the names and shapes that a trained model of this kind has."""
    r = np.random.default_rng(seed)
    out = {}

    def linear(name, a, b):
        out[f"{name}.weight"], out[f"{name}.bias"] = r.normal(0, 0.3, (b, a)), r.normal(0, 0.3, b)

    linear("emb_model.pre_mp.0", width, hidden)
    for i in range(layers):
        size = hidden * (i + 1) if skip != "none" else hidden
        if kind == "GIN":
            linear(f"emb_model.convs.{i}.nn.0", size, hidden)
            linear(f"emb_model.convs.{i}.nn.2", hidden, hidden)
        elif kind == "SAGE":
            linear(f"emb_model.convs.{i}.lin", size, hidden)
            linear(f"emb_model.convs.{i}.lin_update", hidden + size, hidden)
        else:
            out[f"emb_model.convs.{i}.lin.weight"], out[f"emb_model.convs.{i}.bias"] = r.normal(0, 0.3, (hidden, size)), r.normal(0, 0.3, hidden)
    for at, a, b in ((0, hidden * (layers + 1), hidden), (3, hidden, hidden), (5, hidden, 256), (7, 256, hidden)):
        linear(f"emb_model.post_mp.{at}", a, b)
    linear("mlp.0", 2 * hidden, 256)
    linear("mlp.2", 256, 2)
    if skip == "learnable":
        out["emb_model.learnable_skip"] = r.normal(size=(layers, layers))
    return out


def weights(width, hidden=4, layers=2, seed=0, kind="GIN", skip="all"):
    return L.weights_of_state(state(width, hidden, layers, seed, kind, skip), layers, kind)


def by_hand(x, edges, s, layers, kind, skip):
    """The network node by node, from the saved state."""
    lin = lambda name, v: s[f"{name}.weight"] @ v + s[f"{name}.bias"]
    ramp = lambda v: np.array([max(a, 0.0) for a in v])
    n = len(x)
    seen = [[lin("emb_model.pre_mp.0", v)] for v in x]
    into = {v: [a for a, b in edges if b == v and a != v] for v in range(n)}
    for i in range(layers):
        c = f"emb_model.convs.{i}"
        if skip == "learnable":
            e = [np.concatenate([h / (1 + np.exp(-s["emb_model.learnable_skip"][i, k])) for k, h in enumerate(seen[v])]) for v in range(n)]
        else:
            e = [np.concatenate(seen[v]) if skip == "all" else seen[v][-1] for v in range(n)]
        new = []
        for v in range(n):
            if kind == "GIN":
                y = lin(f"{c}.nn.2", ramp(lin(f"{c}.nn.0", e[v] + sum((e[w] for w in into[v]), np.zeros_like(e[v])))))
            elif kind == "SAGE":
                y = lin(f"{c}.lin_update", np.concatenate([sum((lin(f"{c}.lin", e[w]) for w in into[v]), np.zeros(len(seen[v][0]))), e[v]]))
            else:
                d = lambda w: len(into[w]) + 1
                y = sum(s[f"{c}.lin.weight"] @ e[w] / np.sqrt(d(v) * d(w)) for w in [*into[v], v]) + s[f"{c}.bias"]
            new.append(ramp(y))
        for v in range(n):
            seen[v].append(new[v])
    pooled = sum(np.concatenate(h) for h in seen)
    out = lin("emb_model.post_mp.0", pooled)
    out = np.array([a if a > 0 else 0.1 * a for a in out])
    return lin("emb_model.post_mp.7", ramp(lin("emb_model.post_mp.5", ramp(lin("emb_model.post_mp.3", out)))))


@pytest.mark.parametrize("kind", ["GIN", "SAGE", "GCN"])
@pytest.mark.parametrize("skip", ["all", "learnable", "none"])
def test_network_by_hand(kind, skip):
    x, e = np.eye(3)[[0, 1, 2, 1, 0]], np.array([(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (3, 3)])
    s = state(3, 4, 3, 5, kind, skip)
    w = L.weights_of_state(s, 3, kind)
    got = L.graph_embedding(x, e, w, 3, kind, skip)
    assert np.allclose(got, by_hand(x, e.tolist(), s, 3, kind, skip))
    z = s["mlp.2.weight"] @ np.maximum(s["mlp.0.weight"] @ np.concatenate([got, got]) + s["mlp.0.bias"], 0) + s["mlp.2.bias"]
    assert L.pair_probability(got, got, w) == pytest.approx(np.exp(z[1]) / np.exp(z).sum())


def test_network_doesnt_see_the_numbering():
    w, rng = weights(3), np.random.default_rng(1)
    x, e = np.eye(3)[[0, 1, 2, 1]], np.array([(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)])
    at = rng.permutation(4)
    moved = np.empty_like(x)
    moved[at] = x
    a, b = L.graph_embedding(x, e, w, 2), L.graph_embedding(moved, at[e], w, 2)
    assert np.allclose(a, b) and not np.allclose(a, L.graph_embedding(x, e[:4], w, 2))
    assert 0 <= L.pair_probability(a, b, w) <= 1


def test_candidates_and_evaluation(spark):
    edges, labels = random_graph(9)
    g = graph(spark, edges, labels)
    cand, e, _ = P.by_neighbour_labels(g, P3)
    score = lambda nodes, edges_, p, u: float(len(nodes) >= 3)
    assert rows(L.learned_candidates(e, g.vertices, cand, P3, score)) == rows(cand)
    net = L.gin_score(weights(3), 3, 2)
    some = L.learned_candidates(e, g.vertices, cand, P3, net)
    assert set(rows(some)) <= set(rows(cand))
    truth = L.true_candidates(M.match(g, P3))
    universe = P.label_candidates(g.vertices, P3)
    r = L.evaluation(cand, truth, universe).first()
    t, c, u = set(rows(truth)), set(rows(cand)), set(rows(universe))
    assert (r.tp, r.fp, r.fn, r.tn) == (len(t & c), len(c - t), len(t - c), len(u - t - c)) and r.recall == 1.0
    kept = M.match(g, P3, candidate_filter=lambda x: x.where("v <> 0"))
    assert set(rows(kept)) == {m for m in rows(M.match(g, P3)) if 0 not in m}


def test_neighbourhoods_stream_through_a_task(spark):
    """No neighbourhood is gathered in a row; one that spans many batches comes whole to the score."""
    edges, labels = random_graph(5, n=24, m=40)
    g, near, size = graph(spark, edges, labels), adjacency(edges), 10_000
    cand = P.label_candidates(g.vertices, P3)
    want = {}
    for v in labels:
        seen = {v}
        for _ in range(L.HOPS):
            seen |= {w for x in seen for w in near.get(x, ())}
        want[v] = (len(seen), sum(w in seen for x in seen for w in near.get(x, ())))
    sizes = sorted(want.values())[len(want) // 2]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = L.learned_candidates(g.simple, g.vertices, cand, P3, lambda n, e, p, u: float((len(n), len(e)) == sizes))
        assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert rows(found) == [(v, u) for v, u in rows(cand) if want[v] == sizes] != []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_is_exact(spark, seed):
    """Scores that differ in the ninth digit only are different."""
    rng = np.random.default_rng(seed)
    data = [(float(0.5 + rng.integers(0, 400) * 1e-9), bool(rng.random() < 0.3)) for _ in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = L.ranking_quality(spark.createDataFrame(data, "score double, positive boolean")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    pos, neg = [s for s, p in data if p], [s for s, p in data if not p]
    assert r.auroc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)), rel=1e-12)
    want = sum(sum(p for s, p in data if s >= x) / sum(s >= x for s, _ in data) for x in pos) / len(pos)
    assert r.average_precision == pytest.approx(want, rel=1e-12)


def test_ranking(spark):
    data = [(0.9, True), (0.8, False), (0.7, True), (0.7, False), (0.1, False)]
    r = L.ranking_quality(spark.createDataFrame(data, "score double, positive boolean")).first()
    pos, neg = [s for s, p in data if p], [s for s, p in data if not p]
    assert r.auroc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / 6)
    assert r.average_precision == pytest.approx((1 / 1 + 2 / 4) / 2)
    assert L.ranking_quality(spark.createDataFrame([(0.5, True)], "score double, positive boolean")).first().auroc is None


def test_neighbourhoods_are_searched_without_a_shuffle_of_their_rows(spark):
    edges, _ = random_graph(4, n=30, m=45)
    e = L.clean_edges(graph(spark, edges + [(0, v) for v in range(100, 130)]).lines)
    c = spark.createDataFrame([(v,) for v in (*range(12), 110, 999)], "v long")
    nodes = L.ego_nodes(e, c)
    assert rows(nodes) == rows(L._joined_nodes(e, c, L.HOPS))
    assert (999, 999, 0) in rows(nodes)
    assert "Join" not in nodes._jdf.queryExecution().executedPlan().toString()


def test_edges_of_neighbourhoods_are_found_without_a_shuffle_of_their_rows(spark):
    edges, _ = random_graph(5, n=30, m=45)
    e = L.clean_edges(graph(spark, edges + [(0, v) for v in range(100, 130)]).lines)
    c = spark.createDataFrame([(v,) for v in (*range(12), 110, 999)], "v long")
    found = L.edges_around(e, c)
    assert rows(found) == rows(L.ego_edges(e, L._joined_nodes(e, c, L.HOPS)))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
