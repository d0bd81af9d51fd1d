"""Triangles by blocks of the graph: no wedge leaves the task that makes it.

Vertices are dealt to colours by a hash. Three colours make a task, which gets the edges between them and finds the
triangles with one vertex of each; two colours make one for the triangles within them. Every edge is sent to one task
less than there are colours, packed, and the colours are so many that a task holds about EDGES of them.
"""

from __future__ import annotations

import io
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a task holds, where no hub makes it more.
EDGES = 6_000_000

#: With fewer edges one task does all.
ONE_TASK = 100_000

#: Edges that are packed together, and wedges that are looked up at once.
PACKED, AT_ONCE = 2_000_000, 500_000

_PACKS = "tasks array<int>, first int, second int, pack binary"
_TRIANGLES = "a long, b long, c long"


def colours_for(edges: int, most: int = EDGES) -> int:
    """Of c colours, three are on both ends of about 6/c^2 of the edges."""
    return 2 if edges <= min(ONE_TASK, most) else max(4, math.ceil(math.sqrt(6 * edges / most)))


def _mixed(x: np.ndarray, more: int) -> np.ndarray:
    """A hash of 64 bits."""
    x = (x.astype(np.uint64) + np.uint64(more)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _colour(v: np.ndarray, colours: int) -> np.ndarray:
    return (_mixed(v, 1) % np.uint64(colours)).astype(np.int32)


def _tasks(colours: int) -> list[tuple[int, ...]]:
    """The colours of each task; those of three first, as they take longest."""
    c = range(colours)
    return [(i, j, k) for i in c for j in c for k in c if i < j < k] + [(i, j) for i in c for j in c if i < j]


def _in_order(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, sorted."""
    if len(a) and min(a.min(), b.min()) >= 0 and max(a.max(), b.max()) < 1 << 31:
        both = np.unique(a << 32 | b)
        return both >> 32, both & 0xFFFFFFFF
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _pack(a: np.ndarray, b: np.ndarray) -> bytes:
    out = io.BytesIO()
    small = {"use_dictionary": False, "column_encoding": "DELTA_BINARY_PACKED", "compression": "zstd", "write_statistics": False}
    pq.write_table(pa.table({"a": a, "b": b}), out, **small)
    return out.getvalue()


def _unpack(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [pq.read_table(io.BytesIO(x), use_threads=False) for x in packs]
    return tuple(np.concatenate([p[c].to_numpy() for p in parts] or [np.empty(0, np.int64)]) for c in ("a", "b"))


def _packer(colours: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (a, b) packed by their colours; a loop says that its vertex is one, and goes to all tasks of its colour."""
    tasks = _tasks(colours)
    edge_tasks = {(i, j): [t for t, own in enumerate(tasks) if i in own and j in own and (i != j or len(own) == 2)] for i in range(colours) for j in range(i, colours)}
    loop_tasks = [[t for t, own in enumerate(tasks) if i in own] for i in range(colours)]

    def packed(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        loops = a == b
        v = np.unique(a[loops])
        a, b = a[~loops], b[~loops]
        i, j = _colour(a, colours), _colour(b, colours)
        turn = (i > j) | ((i == j) & (a > b))
        a, b, i, j = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, j, i), np.where(turn, i, j)
        block = i * colours + j
        del turn, loops, i, j
        by = np.argsort(block, kind="stable")
        a, b, ends = a[by], b[by], np.searchsorted(block[by], np.arange(colours * colours + 1))
        out = []
        for (i, j), to in edge_tasks.items():
            x = slice(ends[i * colours + j], ends[i * colours + j + 1])
            if x.start < x.stop:
                out.append((to, i, j, _pack(*_in_order(a[x], b[x]))))
        own = _colour(v, colours)
        for i in range(colours):
            if len(some := v[own == i]):
                out.append((loop_tasks[i], i, -1, _pack(some, some)))
        if out:
            kinds = (pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["tasks", "first", "second", "pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += len(batch)
            if n >= PACKED:
                yield from packed(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield from packed(*map(np.concatenate, zip(*held)))

    return run


class _Closing:
    """Whether there is an edge: most that there aren't are told by a table of hashes, the others by the sorted edges."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, n: int):
        self.n, self.keys = n, np.sort(lo.astype(np.int64) * n + hi)
        self.bits = min(25, max(10, int(len(self.keys)).bit_length() + 3))
        self.seen = np.zeros(1 << self.bits, bool)
        for at in range(0, len(self.keys), AT_ONCE):
            self.seen[self._slot(self.keys[at : at + AT_ONCE])] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def which(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Positions of the pairs that are edges."""
        if not len(self.keys):
            return np.empty(0, np.int64)
        keys = lo.astype(np.int64)
        keys *= self.n
        keys += hi
        maybe = np.flatnonzero(self.seen[self._slot(keys)])
        keys = keys[maybe]
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return maybe[self.keys[at] == keys]


def _wedges(hi: np.ndarray, start: np.ndarray, stop: np.ndarray, lo: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, c) for edges from lo to first, each with all of hi[start:stop], AT_ONCE or a few more at once."""
    count = stop - start
    some = np.flatnonzero(count)
    done = np.cumsum(count[some])
    at, before = 0, 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(done, before + AT_ONCE, "right")))
        e, n = some[at:to], count[some[at:to]]
        begin = np.cumsum(n) - n
        where = np.arange(n.sum()) + np.repeat(start[e] - begin, n)
        yield np.repeat(lo[e], n), np.repeat(first[e], n), hi[where]
        at, before = to, int(done[to - 1])


def _numbered(ends: list[np.ndarray]) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """The different ids, sorted, and what finds their numbers."""
    ends = [x for x in ends if len(x)]
    low, high = min((int(x.min()) for x in ends), default=0), max((int(x.max()) for x in ends), default=-1)
    if high - low < max(1000, sum(map(len, ends))):  # looked up in a table, which is several times as fast
        there = np.zeros(high - low + 1, bool)
        for x in ends:
            there[x - low] = True
        at = np.cumsum(there, dtype=np.int32) - 1
        return np.flatnonzero(there) + low, lambda x: at[x - low]
    ids = np.empty(0, np.int64)
    for x in ends:
        ids = np.union1d(ids, x)
    return ids, lambda x: np.searchsorted(ids, x).astype(np.int32)


def _triangles_of(edges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], own: tuple[int, ...], colours: int, known: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A task's triangles. Its edges go from the end with fewer neighbours in this task to the other, so that a hub costs
    what its smaller neighbours cost. known: the vertices; ends that are none are left out."""
    if known is not None:
        for k in list(edges):
            a, b = edges[k]
            both = _among(a, known) & _among(b, known)
            edges[k] = a[both], b[both]
            del a, b, both
    ids, number = _numbered([x for pair in edges.values() for x in pair])
    degree, n = np.zeros(len(ids), np.int64), len(ids)
    for k, pair in edges.items():
        edges[k] = tuple(map(number, pair))
        for x in edges[k]:
            degree += np.bincount(x, minlength=n)
    by = np.argsort(degree, kind="stable")
    rank = np.empty(n, np.int32)
    rank[by] = np.arange(n, dtype=np.int32)
    ids = ids[by]  # by rank from now on
    del degree, by
    shade = _colour(ids, colours)
    ahead: dict[int, list] = {}  # by the colour of the larger end: edges from the smaller rank to the larger one, sorted
    for colour in own:
        parts = []
        for k, (a, b) in edges.items():
            if colour in k:
                a, b = rank[a], rank[b]
                lo, hi = np.minimum(a, b), np.maximum(a, b)
                mine = shade[hi] == colour
                parts.append(lo[mine].astype(np.int64) << 32 | hi[mine])
        both = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.int64)
        lo, hi = (both >> 32).astype(np.int32), (both & 0xFFFFFFFF).astype(np.int32)
        ahead[colour] = [lo, hi]
        del both, parts
    edges.clear()
    for x in own:
        ahead[x].append(np.searchsorted(ahead[x][0], np.arange(n + 1, dtype=np.int32)))
    three = len(own) == 3
    for x in own:
        for y in own:
            if y < x or (three and x == y):
                continue
            # from one vertex to b of colour x and to c of colour y
            lo, b, _ = ahead[x]
            hi, first = ahead[y][1:]
            if three:
                rest = next(k for k in own if k not in (x, y))
                mine = shade[lo] == rest
            elif x == y:  # the triangles of one colour are for one task of its tasks, that with the next colour
                mine = (shade[lo] != x) | ({x, (x + 1) % colours} == set(own) if colours > 2 else True)
            else:
                mine = np.ones(len(lo), bool)
            at = np.flatnonzero(mine)
            lo, b = lo[at], b[at]
            start = at + 1 if x == y else first[lo]
            parts = []
            for p, q in {(x, y), (y, x)}:  # the edges that can close, by the colours of their smaller and their larger end
                l, h, _ = ahead[q]
                some = shade[l] == p
                parts.append((l[some], h[some]))
            closing = _Closing(*(np.concatenate(z) for z in zip(*parts)), n)
            del parts
            for a, s, t in _wedges(hi, start.astype(np.int64), first[lo + 1].astype(np.int64), lo, b):
                found = closing.which(np.minimum(s, t), np.maximum(s, t))
                if len(found):
                    yield ids[a[found]], ids[s[found]], ids[t[found]]
            del closing


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def _finder(colours: int, marked: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    tasks = _tasks(colours)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        for batch in batches:
            for t, i, j, pack in zip(*(batch.column(k).to_pylist() for k in range(4))):
                held[t][i, j].append(pack)
        for t in sorted(held):
            packs, edges = held.pop(t), {}
            marks = [x for k in list(packs) if k[1] < 0 for x in packs.pop(k)]
            known = np.unique(_unpack(marks)[0]) if marked else None
            for k in list(packs):
                edges[k] = _in_order(*_unpack(packs.pop(k)))
            pa.default_memory_pool().release_unused()
            for found in _triangles_of(edges, tasks[t], colours, known):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "c"])

    return run


def triangles_by_blocks(pairs: DataFrame, n: int, vertices: DataFrame | None = None, most: int = EDGES) -> DataFrame:
    """(a, b, c): every triangle once, of n pairs (a, b), in any order of its vertices; repeated pairs do no harm.

    vertices(id): triangles of others are left out. most: edges that a task may hold.
    """
    colours = colours_for(n, most)
    rows = pairs.where("a <> b").select("a", "b")
    if vertices is not None:
        rows = rows.unionByName(vertices.select(F.col("id").alias("a"), F.col("id").alias("b")))
    packs = rows.mapInArrow(_packer(colours), _PACKS).select(F.explode("tasks").alias("task"), "first", "second", "pack")
    return packs.repartitionById(len(_tasks(colours)), "task").mapInArrow(_finder(colours, vertices is not None), _TRIANGLES)
