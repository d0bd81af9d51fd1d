"""Small graphs and plain Python answers to compare with."""

import itertools
import random

from latticework.graph import Graph

MICRO = {
    "triangle": [(0, 1), (1, 2), (2, 0)],
    "square": [(0, 1), (1, 2), (2, 3), (3, 0)],
    "star": [(0, 1), (0, 2), (0, 3)],
    "multi": [(0, 1), (0, 1), (1, 1)],
    "two": [(0, 1), (5, 6)],
}


def graph(spark, edges, labels=None, weights=None, undirected=True):
    rows = [(a, b, None if weights is None else weights[i]) for i, (a, b) in enumerate(edges)]
    e = spark.createDataFrame(rows, "src long, dst long, weight double")
    v = None if labels is None else spark.createDataFrame(list(labels.items()), "id long, label long")
    return Graph(e, v, undirected)


def random_graph(seed, n=18, m=40, labels=3):
    """Edges with repetitions and loops, labels; some vertices have no edge."""
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    edges += [edges[0], (3, 3)]
    return edges, {v: rng.randrange(labels) for v in range(n + 2)}


def adjacency(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def embeddings(edges, labels, p, induced=False):
    near = adjacency(edges)
    out = []
    for m in itertools.permutations(labels, p.n) if p.n <= 3 else backtrack(near, labels, p):
        if any(p.labels[u] not in (None, labels[v]) for u, v in enumerate(m)):
            continue
        if not all(m[b] in near.get(m[a], ()) for a, b in p.edges):
            continue
        if induced and any(m[b] in near.get(m[a], ()) for a in range(p.n) for b in range(a) if b not in p.neighbours(a)):
            continue
        out.append(m)
    return sorted(out)


def backtrack(near, labels, p):
    def go(m):
        u = len(m)
        if u == p.n:
            yield tuple(m)
            return
        for v in labels:
            if v not in m and p.labels[u] in (None, labels[v]) and all(v in near.get(m[w], ()) for w in p.neighbours(u) if w < u):
                yield from go([*m, v])

    yield from go([])
