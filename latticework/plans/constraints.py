"""Walk constraints for a query, and the order in which its vertices are matched."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from latticework.plans.pattern import Pattern, Walk


def cycle_walk(p: Pattern, u: int) -> Walk | None:
    """The cycle through u with the largest part of different labels, the shortest of these."""
    best = None
    for c in p.cycles():
        if u in c:
            at = c.index(u)
            turned = c[at:] + c[:at]
            rank = (len({p.labels[w] for w in c}) / len(c), -len(c))
            if best is None or rank > best[0]:
                best = (rank, turned)
    return Walk((*best[1], u), cyclic=True) if best else None


def path_walk(p: Pattern, u: int) -> Walk | None:
    """The shortest path from u to another vertex of its label, if it has a vertex in between."""
    paths = [p.shortest_path(u, w) for w in range(p.n) if w != u and p.labels[w] == p.labels[u]]
    paths = [x for x in paths if len(x) > 2]
    return Walk(tuple(min(paths, key=len)), cyclic=False) if paths else None


def generate(p: Pattern, mode: str = "rare", counts: Mapping[int, int] | None = None, part: float = 1.0, seed: int = 0) -> list[Walk]:
    """Constraints for a query.

    mode: "rare" starts at the vertices with the rarest labels by ``counts`` (label -> number of data vertices),
    "random" at random ones with a random kind of constraint, "all" takes every cycle, every pair of equal labels
    and the merged cycles, "none" nothing. part: the part of the query's vertices to start at.
    """
    if mode == "none":
        return []
    if mode == "all":
        out = [Walk((*c, c[0]), cyclic=True) for c in p.cycles()]
        for a in range(p.n):
            for b in range(a + 1, p.n):
                if p.labels[a] == p.labels[b] and len(x := p.shortest_path(a, b)) > 2:
                    out.append(Walk(tuple(x), cyclic=False))
        for edges in p.merged_cycles():
            walk = p.covering_walk(min(min(e) for e in edges), edges)
            out.append(Walk(tuple(walk), cyclic=walk[0] == walk[-1], search=True))
        return out
    n = max(1, round(p.n * part))
    rng = random.Random(seed)
    if mode == "random":
        starts = rng.sample(range(p.n), n)
    else:
        starts = sorted(range(p.n), key=lambda u: ((counts or {}).get(p.labels[u], 0), u))[:n]
    out = []
    for u in starts:
        kinds = [cycle_walk, path_walk]
        if mode == "random":
            rng.shuffle(kinds)
        found = next((w for k in kinds if (w := k(p, u))), None)
        if found and found not in out:
            out.append(found)
    return out


def rarity(p: Pattern, labels: Mapping[int, int], at_least: Mapping[int, int], n: int) -> list[float]:
    """For each query vertex the part of data vertices with its label times the part with at least its degree."""
    return [labels.get(p.labels[u], 0) / max(n, 1) * (at_least.get(p.degree(u), 0) / max(n, 1)) for u in range(p.n)]


def vf3_order(p: Pattern, rare: Sequence[float], weigh_early: bool = True) -> list[int]:
    """The order of the third VF algorithm: most ties to what is matched, then the rarest, then the largest degree.

    weigh_early: a tie counts once for every step since its end was matched, else once.
    """
    order: list[int] = []
    while len(order) < p.n:
        age = {w: len(order) - i if weigh_early else 1 for i, w in enumerate(order)}
        ties = [sum(age.get(w, 0) for w in p.neighbours(u)) for u in range(p.n)]
        order.append(max((u for u in range(p.n) if u not in order), key=lambda u: (ties[u], -rare[u], p.degree(u), -u)))
    return order


def size_order(p: Pattern, sizes: Mapping[int, int]) -> list[int]:
    """Start with the fewest candidates; go on with what has most matched neighbours, of these with the fewest."""
    order = [min(range(p.n), key=lambda u: (sizes.get(u, 0), -p.degree(u), u))]
    while len(order) < p.n:
        near = [u for u in range(p.n) if u not in order and set(p.neighbours(u)) & set(order)]
        near = near or [u for u in range(p.n) if u not in order]
        order.append(min(near, key=lambda u: (-len(set(p.neighbours(u)) & set(order)), sizes.get(u, 0), u)))
    return order


def extensions(p: Pattern, order: Sequence[int]) -> list[list[int]]:
    """For each vertex of the order the neighbours that are matched before it, in matching order."""
    return [[w for w in order[:i] if w in p.neighbours(u)] for i, u in enumerate(order)]


def parents(p: Pattern, order: Sequence[int]) -> dict[int, int | None]:
    """The matched vertex from which each vertex is first reached."""
    return {u: (ext[0] if ext else None) for u, ext in zip(order, extensions(p, order))}


def levels(p: Pattern, order: Sequence[int]) -> list[dict[int | None, list[int]]]:
    """For each number of matched vertices: the open neighbours of the matched ones, by label."""
    out = []
    for i in range(1, p.n + 1):
        near: dict[int | None, list[int]] = {}
        for u in order[i:]:
            if set(p.neighbours(u)) & set(order[:i]):
                near.setdefault(p.labels[u], []).append(u)
        out.append(near)
    return out
