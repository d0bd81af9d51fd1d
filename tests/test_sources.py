import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphs import MICRO, graph, random_graph
from latticework.functions import bits
from latticework.graph import Graph
from latticework.operators import dense, match, prune
from latticework.plans.pattern import Pattern
from latticework.sources import generate, sample, text
from latticework.streaming import ingest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_edge_lists(spark, tmp_path):
    (tmp_path / "a").write_text("1 2\n 3\t4 \n\n")
    (tmp_path / "b").write_text("1 2 0.5\n2 3\n")
    assert rows(text.read_edges(spark, str(tmp_path / "a"))) == [(1, 2, None), (3, 4, None)]
    assert rows(text.read_edges(spark, str(tmp_path / "b"), undirected=True)) == [(1, 2, 0.5), (2, 1, 0.5), (2, 3, 0.0), (3, 2, 0.0)]
    for bad in ("-1 2", "1 18446744073709551615", "1 x"):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(Exception):
            text.read_edges(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "none").write_text("")
    assert text.read_edges(spark, str(tmp_path / "none")).count() == 0


def test_labels(spark, tmp_path):
    (tmp_path / "l.1").write_text("1 5\n2 6\n")
    (tmp_path / "l.2").write_text("3 7\n2 4\n")
    (tmp_path / "list").write_text(f"{tmp_path}/l.1\n/not/here/l.2")
    want = [(1, 5), (2, 4), (3, 7)]
    assert rows(text.read_labels(spark, f"{tmp_path}/l.*")) == want == rows(text.read_label_list(spark, str(tmp_path / "list")))


def test_factor(spark, tmp_path):
    (tmp_path / "k").write_text("3\n0 1 2\n1 2 1\n2 2 4\n")
    n, e = text.read_factor(spark, str(tmp_path / "k"))
    assert n == 3 and rows(e) == [(0, 1, 2), (1, 0, 2), (1, 2, 1), (2, 1, 1), (2, 2, 4)]
    (tmp_path / "k").write_text("3\n0 1\n")
    with pytest.raises(Exception):
        text.read_factor(spark, str(tmp_path / "k"))[1].collect()


def test_hdf5_needs_its_library(spark):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(NotImplementedError):
            text.read_hdf5(spark, ["x"], "s", "t")


def test_store(spark, tmp_path):
    g = graph(spark, MICRO["two"], {0: 1, 1: 2, 9: 3}, [1.0, None])
    at, to = str(tmp_path / "g"), str(tmp_path / "copy")
    g.save(at)
    Graph.copy(spark, at, to)
    with pytest.raises(FileExistsError):
        Graph.copy(spark, at, to)
    back = Graph.load(spark, to)
    assert rows(back.vertices) == rows(g.vertices) and rows(back.edges) == rows(g.edges)
    assert Graph.partitions(spark, to) >= 1
    assert Graph.remove(spark, to) and not Graph.exists(spark, to) and not Graph.remove(spark, to)


def test_sinks(spark, tmp_path):
    edges, labels = random_graph(3)
    g, p = graph(spark, edges, labels), Pattern.of([0, 1, 0], [(0, 1), (1, 2)])
    m = match.match(g, p)
    text.write_matches(m, str(tmp_path / "m"))
    assert sorted(tuple(map(int, r.value.split())) for r in spark.read.text(str(tmp_path / "m")).collect()) == rows(m)
    text.write_walks(m, [0, 1, 2, 1], str(tmp_path / "w"))
    assert all(len(r.value.split(", ")) == 4 for r in spark.read.text(str(tmp_path / "w")).collect())
    cand, e, _ = prune.by_neighbour_labels(g, p)
    v = prune.candidate_bits(cand, g.vertices)
    text.pruned_lines(v, e).write.text(str(tmp_path / "p"))
    v2, e2 = text.read_pruned(spark, str(tmp_path / "p"))
    assert rows(v2) == rows(v.select("id", "label", "bits")) and rows(e2) == rows(e)
    text.write_lines(dense.edge_triangles(g.pairs), str(tmp_path / "t"), "a", "b", "n")
    assert spark.read.text(str(tmp_path / "t")).count() == g.pairs.count()


def test_hashes(spark):
    x = np.arange(0, 5000, 7)
    df = spark.createDataFrame([(int(i),) for i in x], "x long")
    for width in (16, 32):
        got = [r.h for r in df.orderBy("x").select(bits.hash_column(F.col("x"), width).alias("h")).collect()]
        assert got == bits.hash_array(x, width).tolist()
    for n in (17, 20, 32, 40):
        got = [r.h for r in df.orderBy("x").select(bits.scramble_column(F.col("x"), n).alias("h")).collect()]
        assert got == bits.scramble_array(x, n).tolist()
    every = np.arange(1 << 17)
    assert sorted(bits.scramble_array(every, 17).tolist()) == every.tolist()
    with pytest.raises(ValueError):
        bits.scramble_array(x, 16)
    same = df.where(bits.owner(F.col("x"), F.col("x") + 1, 9) != bits.owner(F.col("x") + 1, F.col("x"), 9))
    assert same.count() == 0
    assert df.where("x < 63").agg(bits.bit_set(F.col("x") % 5).alias("b")).select(bits.has_bit(F.col("b"), 4)).first()[0]


def test_rmat(spark):
    a = generate.rmat(spark, 10, 70_000, seed=3)
    assert rows(a) == rows(generate.rmat(spark, 10, 70_000, seed=3).repartition(3)) and a.count() == 70_000
    assert a.where("src < 0 OR src >= 1024 OR dst < 0 OR dst >= 1024").count() == 0
    assert generate.rmat(spark, 17, 1000, undirected=True).count() == 2000
    u = generate.rmat_unique(spark, 7, 900)
    assert u.count() == 900 == u.distinct().count() and u.where("a >= b").count() == 0
    assert generate.both_ways(u).count() == 1800
    with pytest.raises(ValueError):
        generate.rmat_unique(spark, 2, 100)
    c = generate.degree_checks(a, 500).first()
    ids = [v for r in a.collect() for v in r]
    assert (c.ends, c.id_xor) == (140_000, int(np.bitwise_xor.reduce(ids)))


def test_kronecker_triangles(spark):
    """A product's edge weight is its number of triangles if its factors' weights are."""
    tri = [(a, b, 1) for a in range(3) for b in range(3) if a != b]
    f = spark.createDataFrame(tri, "src long, dst long, weight long")
    k = generate.kronecker(f, f, 3)
    assert k.count() == 36
    g = Graph(k.where("src < dst"))
    want = {(r.src, r.dst): r.weight for r in k.where("src < dst").collect()}
    assert {(r.a, r.b): r.n for r in dense.edge_triangles(g.pairs).collect()} == want
    assert dense.triangle_count(g).first().triangles == k.agg(F.sum("weight")).first()[0] // 6
    assert generate.kronecker(f, f, 3, scramble_bits=17).distinct().count() == 36


def test_preferential_and_dense(spark):
    for rewire in (False, True):
        e = generate.preferential(spark, 300, 3, 0.6, rewire=rewire)
        assert e.count() == 900 and e.where("dst IS NULL OR dst < 0 OR dst >= 300").count() == 0
    assert e.groupBy("dst").count().agg(F.max("count")).first()[0] > 15
    assert rows(generate.upper_triangle(spark, 7)) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (2, 2)]


def test_samples(spark):
    edges, labels = random_graph(4, n=30, m=80)
    g = graph(spark, edges, labels)
    near = {(a, b) for x in edges for a, b in (x, x[::-1])}
    path = sample.walk(g, 8, seed=2)
    assert len(set(path)) == len(path) and all(s in near for s in zip(path, path[1:]))
    v, e = sample.sample_subgraph(g, 12, seed=1)
    ids = {r.id for r in v.collect()}
    assert len(ids) == 12 and {tuple(r) for r in e.collect()} == {(a, b) for a, b in near if {a, b} <= ids}
    for kind in ("path", "cycle", "tree", "other"):
        p = sample.query(g, 4, kind, seed=1, tries=30, constrained=False)
        assert p.connected() and p.n == 4 and match.match(g, p, pruning=False).count() > 0
        assert len(p.edges) == {"path": 3, "cycle": 4, "tree": 3}.get(kind, len(p.edges))
    assert sorted(sample.queries_from(g, 2, 3, "path", first_number=5)) == [5, 6]
    assert sample.walk(graph(spark, []), 3) == []


def test_a_cycle_is_found_where_walks_hardly_close(spark):
    """In a sparse graph a walk's ends are seldom neighbours; one try finds a cycle, of any length."""
    edges, _ = random_graph(5, n=300, m=2400)
    g = graph(spark, edges, {v: v % 3 for v in range(302)})
    for n in (3, 4, 5):
        for seed in (1, 2):
            p = sample.query(g, n, "cycle", seed=seed, tries=1, constrained=False)
            assert p.n == n == len(p.edges) and all(p.degree(u) == 2 for u in range(n)) and not match.match(g, p).isEmpty()


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1").write_text("1 2 0.5\nnot an edge\n3,4\n-1 2\n\n7\n5 6 heavy\n")
    store, check = str(tmp_path / "g"), str(tmp_path / "c")

    def load():
        for q in ingest.ingest(spark, str(src), store, check):
            q.awaitTermination()
        return rows(spark.read.parquet(f"{store}/edges").select("src", "dst", "weight"))

    assert load() == [(1, 2, 0.5), (3, 4, 0.0)]
    assert rows(spark.read.parquet(f"{store}/rejects")) == [("-1 2", "id"), ("5 6 heavy", "weight"), ("7", "columns"), ("not an edge", "id")]
    (src / "2").write_text("5 6\n")
    assert load() == [(1, 2, 0.5), (3, 4, 0.0), (5, 6, 0.0)]
    assert rows(Graph.load(spark, store).degrees()) == [(i, 1) for i in range(1, 7)]
    q = ingest.degree_stream(ingest.edge_stream(spark, str(src))).writeStream.format("memory").queryName("deg").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.sql("select * from deg")) == [(i, 1) for i in range(1, 7)]
    one_way = str(tmp_path / "d")
    ingest.store_stream(ingest.edge_stream(spark, str(src)), one_way, str(tmp_path / "e"), undirected=False).awaitTermination()
    assert rows(Graph.load(spark, one_way).degrees()) == [(1, 1), (3, 1), (5, 1)]


def test_stream_and_batch_read_alike(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_text("1 2 0.5\n3,4\n 5\t6 , 7\n")
    ingest.store_stream(ingest.edge_stream(spark, str(tmp_path / "in")), str(tmp_path / "g"), str(tmp_path / "c")).awaitTermination()
    stored = spark.read.parquet(f"{tmp_path}/g/edges").select("src", "dst", "weight")
    assert rows(stored) == rows(text.read_edges(spark, str(tmp_path / "in"))) == [(1, 2, 0.5), (3, 4, 0.0), (5, 6, 7.0)]


def test_bad_factor_lines_fail(spark, tmp_path):
    for bad in ("2\n0 1 1\n7\n", "0 1 1\n", "2\n0 1\n", "", "x\n0 1 1\n"):
        (tmp_path / "f").write_text(bad)
        with pytest.raises(Exception):
            text.read_factor(spark, str(tmp_path / "f"))[1].collect()


def test_rewiring_permutes_at_any_size(spark):
    for m in (1, 2, 12, 10**6, 2_654_435_761 * 2, 10**12, 2**40):
        step = generate.coprime(m)
        assert math.gcd(step, m) == 1 and step * m < 1 << 63
    e = generate.preferential(spark, 300, 3, 0.6, rewire=True)
    assert sorted(r.src for r in e.collect()) == sorted(i // 3 for i in range(900))


def test_a_graph_from_a_file_gives_queries(spark, tmp_path):
    edges, labels = random_graph(4, n=30, m=80)
    lines = [f"v {v} {x}" for v, x in labels.items()] + [f"e {a} {b}" for a, b in edges]
    (tmp_path / "g").write_text("\n".join(lines))
    g = sample.graph_of_files(spark, str(tmp_path / "g"))
    assert rows(g.vertices) == sorted(labels.items()) and rows(g.pairs) == rows(graph(spark, edges).pairs)
    p = sample.queries_from(g, 1, 3, "path", seed=2, first_number=7)[7]
    assert p.n == 3 and not match.match(g, p).isEmpty()


def test_a_walk_goes_to_every_neighbour_of_a_hub(spark):
    """A self-avoiding walk back and forth over a hub of 400: all its neighbours are within reach."""
    g = graph(spark, [(0, i) for i in range(1, 400)])
    assert len(set(sample.walk(g, 30, seed=3, jump=True))) == 30


STAND_IN = """
import numpy


class File(dict):
    \'\'\'Reads what numpy saved, as far as the reader asks for it.\'\'\'

    def __init__(self, path):
        super().__init__(numpy.load(path))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass
"""


def test_hdf5_by_a_stand_in(tmp_path):
    """The reader over files that a stand-in for the missing library opens, in a process of its own."""
    (tmp_path / "h5py.py").write_text(STAND_IN.replace("\\'", "'"))
    script = f"""
import sys
sys.path[:0] = [{str(HERE)!r}, {str(tmp_path)!r}]
import numpy
from latticework.session import local_session
from latticework.sources.text import read_hdf5
spark = local_session(cores=2, shuffle_partitions=2, memory="1g", app="hdf5")
for i in (1, 2):
    numpy.savez({str(tmp_path)!r} + f"/{{i}}.npz", s=numpy.arange(3) + i, t=numpy.arange(3) * i, w=numpy.arange(3))
paths = [{str(tmp_path)!r} + f"/{{i}}.npz" for i in (1, 2)]
print("ROWS", sorted(map(tuple, read_hdf5(spark, paths, "s", "t", "w").collect())))
print("BARE", sorted(map(tuple, read_hdf5(spark, paths[:1], "s", "t").collect())))
"""
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(HERE), str(tmp_path)])}
    out = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS [(1, 0, 0.0), (2, 0, 0.0), (2, 1, 1.0), (3, 2, 1.0), (3, 2, 2.0), (4, 4, 2.0)]" in out.stdout, out.stderr[-2000:]
    assert "BARE [(1, 0, None), (2, 1, None), (3, 2, None)]" in out.stdout
