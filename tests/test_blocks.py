import itertools
import random

import numpy as np
import pytest

from graphs import adjacency, embeddings, graph, random_graph
from latticework.operators import blocks as B
from latticework.operators import match as M
from latticework.plans.pattern import Pattern

TRIANGLE = Pattern.of([None] * 3, [(0, 1), (1, 2), (0, 2)])


def rows(df):
    return sorted(map(tuple, df.collect()))


def triangles(edges, known=None):
    near = adjacency(edges)
    found = {tuple(sorted((a, b, c))) for a in near for b in near[a] for c in near[a] & near[b]}
    return sorted(t for t in found if known is None or set(t) <= set(known))


def test_a_triangle_without_labels_moves_no_wedges(spark):
    edges, labels = random_graph(4, n=16, m=70)
    got = M.match(graph(spark, edges, labels), TRIANGLE)
    assert rows(got) == embeddings(edges, labels, TRIANGLE) != []
    assert "Join" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("most,colours", [(1000, 2), (90, 4), (30, 7)])
@pytest.mark.parametrize("shift", [0, 1 << 40, -20])
def test_blocks_like_brute_force(spark, most, colours, shift):
    rng = random.Random(most)
    edges = [(0, v) for v in range(1, 45)] + [(rng.randrange(45), rng.randrange(45)) for _ in range(156)]
    edges = [(shift + a, shift + b) for a, b in edges]
    known = [shift + v for v in range(40)]
    pairs = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert B.colours_for(len(edges), most) == colours
    for vertices in (None, spark.createDataFrame([(v,) for v in known], "id long")):
        got = [tuple(sorted(t)) for t in B.triangles_by_blocks(pairs, len(edges), vertices, most).collect()]
        assert sorted(got) == triangles(edges, None if vertices is None else known) != []


def test_every_edge_goes_to_one_task_less_than_colours_and_every_triangle_to_one():
    for colours in (2, 4, 5):
        tasks = B._tasks(colours)
        for i, j in itertools.combinations(range(colours), 2):
            assert sum({i, j} <= set(t) for t in tasks) == colours - 1
    assert B.colours_for(72_000_000) == 9
    assert set(B._colour(np.arange(1000), 9)) == set(range(9))


def test_no_edges(spark):
    assert rows(M.match(graph(spark, [], {1: 0}), TRIANGLE)) == []
    assert rows(M.match(graph(spark, [(1, 2), (2, 3)], {}), TRIANGLE)) == []
