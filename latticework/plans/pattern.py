"""Query graphs: small labelled graphs on the driver, with what planning needs to know about them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from math import comb
from pathlib import Path


@dataclass(frozen=True)
class Pattern:
    """A query graph: labels[u] is the label of query vertex u (None: any), edges are pairs of query vertices.

    Edges are undirected unless ``directed``; repeated ones count once. A vertex may have no edge only if the
    pattern is that vertex.
    """

    labels: tuple[int | None, ...]
    edges: tuple[tuple[int, int], ...]
    weights: tuple[float | None, ...] = ()
    constraints: tuple[str, ...] = field(default=(), compare=False)
    directed: bool = False

    @staticmethod
    def of(labels: Sequence[int | None], edges: Iterable[tuple[int, int]], directed: bool = False, weights: Sequence[float | None] = (), **more) -> Pattern:
        """weights: one for each of edges, or none at all; a repeated edge keeps its first."""
        found, kept = [], []
        edges = list(edges)
        for (a, b), w in zip(edges, weights or [None] * len(edges), strict=True):
            if not (0 <= a < len(labels) and 0 <= b < len(labels)):
                raise ValueError(f"edge ({a}, {b}) names no vertex of the pattern")
            if a == b:
                raise ValueError(f"loop at query vertex {a}")
            e = (a, b) if directed else (min(a, b), max(a, b))
            if e not in found:
                found.append(e)
                kept.append(w)
        return Pattern(tuple(labels), tuple(found), tuple(kept) if weights else (), directed=directed, **more)

    @property
    def n(self) -> int:
        return len(self.labels)

    def neighbours(self, u: int) -> list[int]:
        return sorted({b if a == u else a for a, b in self.edges if u in (a, b)})

    def successors(self, u: int) -> list[int]:
        """The ends of u's edges: all neighbours, or in a directed pattern those that u points to."""
        return sorted({b for a, b in self.edges if a == u}) if self.directed else self.neighbours(u)

    def out_degree(self, u: int) -> int:
        return sum(a == u for a, _ in self.edges) if self.directed else self.degree(u)

    def in_degree(self, u: int) -> int:
        return sum(b == u for _, b in self.edges) if self.directed else self.degree(u)

    def degree(self, u: int) -> int:
        return len(self.neighbours(u))

    def need(self) -> list[tuple[int, int, int]]:
        """(u, label, k): u has k neighbours with that label; in a directed pattern, of those it points to."""
        out: dict[tuple[int, int], int] = {}
        for u in range(self.n):
            for w in self.successors(u):
                if self.labels[w] is not None:
                    out[u, self.labels[w]] = out.get((u, self.labels[w]), 0) + 1
        return [(u, label, k) for (u, label), k in sorted(out.items())]

    def distances(self, u: int) -> dict[int, int]:
        seen, front = {u: 0}, [u]
        while front:
            front = [w for v in front for w in self.neighbours(v) if w not in seen and not seen.update({w: seen[v] + 1})]
        return seen

    def connected(self) -> bool:
        return len(self.distances(0)) == self.n if self.n else False

    def diameter(self) -> int:
        return max(max(self.distances(u).values()) for u in range(self.n))

    def without(self, edges: Iterable[tuple[int, int]]) -> Pattern:
        gone = set(edges)
        return Pattern.of(self.labels, [e for e in self.edges if e not in gone], self.directed)

    def prototypes(self, k: int) -> list[Pattern]:
        """All patterns that miss k of the edges and are still connected."""
        return [p for gone in combinations(self.edges, k) if (p := self.without(gone)).connected()]

    def prototype_count(self, k: int) -> int:
        """How many ways there are to take away k edges; at most as many prototypes are connected."""
        return comb(len(self.edges), k)

    def automorphisms(self) -> list[tuple[int, ...]]:
        """Every way to map the query's vertices to each other that keeps labels and edges; the identity is one."""
        if self.directed:
            raise ValueError("of undirected queries only")
        near = [set(self.neighbours(u)) for u in range(self.n)]
        found: list[tuple[int, ...]] = []

        def put(image: list[int]) -> None:
            u = len(image)
            if u == self.n:
                found.append(tuple(image))
                return
            for w in range(self.n):
                if w not in image and self.labels[w] == self.labels[u] and len(near[w]) == len(near[u]):
                    if all((x in near[u]) == (image[x] in near[w]) for x in range(u)):
                        put([*image, w])

        put([])
        return found

    def asymmetry(self) -> list[tuple[int, int]]:
        """Pairs (a, b) such that, if the data vertex of a must come before that of b in some order, exactly one of the
        matches that automorphisms make of each other is left."""
        group, out = self.automorphisms(), []
        while len(group) > 1:
            orbits = [{g[u] for g in group} for u in range(self.n)]
            u = max(range(self.n), key=lambda x: (len(orbits[x]), -x))
            out += [(u, w) for w in sorted(orbits[u] - {u})]
            group = [g for g in group if g[u] == u]
        return out

    def cycles(self) -> list[tuple[int, ...]]:
        """Every simple cycle of three vertices or more once, from its smallest vertex towards its smaller neighbour."""
        found = []

        def walk(path: list[int]) -> None:
            for w in self.neighbours(path[-1]):
                if w == path[0] and len(path) > 2 and path[1] < path[-1]:
                    found.append(tuple(path))
                elif w > path[0] and w not in path:
                    walk([*path, w])

        for u in range(self.n):
            walk([u])
        return sorted(found, key=lambda c: (len(c), c))

    def merged_cycles(self) -> list[frozenset[tuple[int, int]]]:
        """Edge sets of the groups of two or more cycles that share edges, each group as large as it gets."""
        groups: list[set[tuple[int, int]]] = []
        sizes: list[int] = []
        for c in self.cycles():
            edges = {(min(a, b), max(a, b)) for a, b in zip(c, (*c[1:], c[0]))}
            size = 1
            for i in reversed([i for i, g in enumerate(groups) if g & edges]):
                edges |= groups.pop(i)
                size += sizes.pop(i)
            groups.append(edges)
            sizes.append(size)
        return [frozenset(g) for g, s in zip(groups, sizes) if s > 1]

    def shortest_path(self, a: int, b: int) -> list[int]:
        back = self.distances(b)
        if a not in back:
            return []
        path = [a]
        while path[-1] != b:
            path.append(min(w for w in self.neighbours(path[-1]) if back.get(w, self.n) == back[path[-1]] - 1))
        return path

    def covering_walk(self, start: int = 0, edges: Iterable[tuple[int, int]] | None = None) -> list[int]:
        """A walk over every edge (of ``edges``), each step along a query edge, also where it goes back."""
        left = set(self.edges if edges is None else edges)
        walk = [start]

        def visit(u: int) -> None:
            for w in self.neighbours(u):
                e = (min(u, w), max(u, w))
                if e in left:
                    left.discard(e)
                    walk.append(w)
                    visit(w)
                    if left:
                        walk.append(u)

        visit(start)
        if left:
            raise ValueError("the edges are not connected to the start")
        return walk


@dataclass(frozen=True)
class Walk:
    """A walk over query vertices that a candidate of its first vertex must be able to take in the data.

    Position i is a new data vertex if it is the walk's first position with that query vertex, else the one chosen
    then. Read and written as ``vertices : first positions : aggregation : cyclic : search : rerun``.
    """

    vertices: tuple[int, ...]
    cyclic: bool
    search: bool = False
    rerun: bool = True

    @property
    def index(self) -> tuple[int, ...]:
        return tuple(self.vertices.index(u) for u in self.vertices)

    def text(self, aggregate: Sequence[int] | None = None) -> str:
        groups = [self.vertices, self.index, aggregate or [0] * len(self.vertices)]
        return " : ".join([*(" ".join(map(str, g)) for g in groups), str(int(self.cyclic)), str(int(self.search)), str(int(self.rerun))])

    @staticmethod
    def read(text: str) -> Walk:
        parts = [p.split() for p in text.split(":")]
        if len(parts) < 6 or len(parts[0]) < 3:
            raise ValueError(f"not a constraint: {text!r}")
        return Walk(tuple(map(int, parts[0])), *(bool(int(p[0])) for p in parts[3:6]))

    def covers(self, pattern: Pattern) -> bool:
        steps = {(min(a, b), max(a, b)) for a, b in zip(self.vertices, self.vertices[1:])}
        return steps >= {(min(e), max(e)) for e in pattern.edges}


def read_pattern(lines: Iterable[str]) -> Pattern:
    """A query in one text: ``v id label``, ``e a b [weight]``, ``c constraint``; ``t`` lines start and end it.

    The line ``c diameter : d`` says what the edges say already and is no constraint.
    """
    labels, edges, weights, constraints = [], [], [], []
    for line in lines:
        kind, _, rest = line.strip().partition(" ")
        at = rest.split()
        if kind == "v":
            if int(at[0]) != len(labels):
                raise ValueError("query vertices must be listed in order")
            labels.append(int(at[1]))
        elif kind == "e":
            edges.append((int(at[0]), int(at[1])))
            weights.append(float(at[2]) if len(at) > 2 else None)
        elif kind == "c" and at[:1] != ["diameter"]:
            constraints.append(rest.strip())
    return Pattern.of(labels, edges, weights=weights, constraints=tuple(constraints))


def write_pattern(p: Pattern, number: int = 0, constraints: Sequence[Walk] = ()) -> str:
    weight = [f" {w:g}" if w is not None else "" for w in p.weights] or [""] * len(p.edges)
    lines = [f"t # {number}", *(f"v {u} {label}" for u, label in enumerate(p.labels)), *(f"e {a} {b}{w}" for (a, b), w in zip(p.edges, weight))]
    if constraints:
        lines.append(f"c diameter : {p.diameter()}")
    return "\n".join([*lines, *(f"c {w.text()}" for w in constraints), "t # -1", ""])


def _rows(path: Path) -> Iterator[list[str]]:
    for line in path.read_text().splitlines():
        if line.strip():
            yield line.split()


def read_pattern_files(folder: str, directed: bool = False) -> Pattern:
    """A query in several files of a folder: pattern_edge (a b), pattern_vertex_data (u label) and, if there,
    pattern_edge_data (a b weight). An undirected query's edges may be listed in one or both directions."""
    at = Path(folder)
    label = {int(r[0]): int(r[1]) for r in _rows(at / "pattern_vertex_data")}
    edges = [(int(r[0]), int(r[1])) for r in _rows(at / "pattern_edge")]
    p = Pattern.of([label[u] for u in range(len(label))], edges, directed)
    data = at / "pattern_edge_data"
    if data.exists():
        weight = {}
        for r in _rows(data):
            a, b = int(r[0]), int(r[1])
            weight[(a, b) if directed else (min(a, b), max(a, b))] = float(r[2])
        p = Pattern(p.labels, p.edges, tuple(weight.get(e) for e in p.edges), directed=directed)
    return p


def write_pattern_files(p: Pattern, folder: str) -> None:
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    (at / "pattern_vertex_data").write_text("".join(f"{u} {label}\n" for u, label in enumerate(p.labels)))
    both = [e for a, b in p.edges for e in ([(a, b)] if p.directed else [(a, b), (b, a)])]
    (at / "pattern_edge").write_text("".join(f"{a} {b}\n" for a, b in sorted(both)))
    stat = f"vertices : {p.n}\nedges : {len(both)}\ndiameter : {p.diameter()}\n"
    (at / "pattern_stat").write_text(stat)


def write_prototypes(p: Pattern, k: int, folder: str) -> list[str]:
    """One folder of pattern files for each pattern with k edges less."""
    out = []
    for i, q in enumerate(p.prototypes(k)):
        out.append(f"{folder}/{k}-{i}")
        write_pattern_files(q, out[-1])
    return out
