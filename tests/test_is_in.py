from graphs import graph, random_graph
from latticework.graph import Graph
from latticework.operators import match as M
from latticework.plans.pattern import Pattern
from latticework.session import stored
from latticework.sources import sample


def test_a_match_among_the_walked_vertices_spares_the_whole_graph(spark, monkeypatch):
    edges, labels = random_graph(5, n=14, m=50)
    g, whole, seen = graph(spark, edges, labels), M.match, []
    monkeypatch.setattr(M, "match", lambda x, p, **how: seen.append(x) or whole(x, p, **how))
    simple = sample.turned_edges(g)
    assert sorted(map(tuple, simple.collect())) == sorted(map(tuple, g.simple.collect()))
    p, walked = sample.drawn(g, 4, "cycle", seed=3, constrained=False, simple=simple)
    assert p == sample.query(g, 4, "cycle", seed=3, constrained=False) and [labels[v] for v in walked] == list(p.labels)
    assert M.is_in(g, p, walked, simple) and g not in seen
    assert M.is_in(g, p, [walked[0]], simple) and seen[-1] is g  # no match there, so all of the graph is matched
    assert M.is_in(g, p) and not M.is_in(g, Pattern.of([0, 99], [(0, 1)]), walked)


def test_a_graph_whose_edges_are_there_once(spark):
    edges = [(0, 1), (0, 2), (1, 2), (2, 3)]
    one, plain = Graph(graph(spark, edges).lines, once=True), graph(spark, edges)
    for name in ("pairs", "simple"):
        assert sorted(map(tuple, getattr(one, name).collect())) == sorted(map(tuple, getattr(plain, name).collect()))
    assert "Exchange" not in one.simple._jdf.queryExecution().toString()


def test_stored_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in map(str, disk.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}
    before = files()
    rows = stored(spark.range(1000).repartition(3))
    assert files() <= before
    assert rows.count() == 1000
