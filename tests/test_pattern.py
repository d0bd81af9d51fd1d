import pytest

from latticework.plans import constraints
from latticework.plans.pattern import Pattern, Walk, read_pattern, read_pattern_files, write_pattern, write_pattern_files, write_prototypes

CYCLE = Pattern.of([7, 7, 4, 22], [(0, 1), (1, 2), (2, 3), (0, 3)])
BRANCH = Pattern.of([1, 2, 3, 4], [(0, 1), (1, 2), (0, 3)])
DIAMOND = Pattern.of([0, 1, 2, 0], [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)])


def test_text_round_trip():
    text = write_pattern(CYCLE, 3, [Walk((0, 1, 2, 3, 0), True)])
    p = read_pattern(text.splitlines())
    assert p == Pattern.of(CYCLE.labels, CYCLE.edges, weights=(None,) * 4)
    assert p.constraints == ("0 1 2 3 0 : 0 1 2 3 0 : 0 0 0 0 0 : 1 : 0 : 1",) and "c diameter : 2" in text
    assert Walk.read(p.constraints[0]) == Walk((0, 1, 2, 3, 0), True)
    assert read_pattern(["t # 0", "v 0 5", "v 1 6", "e 0 1 2.5", "t # -1"]).weights == (2.5,)


def test_bad_queries():
    with pytest.raises(ValueError):
        read_pattern(["v 1 5"])
    with pytest.raises(ValueError):
        Pattern.of([1, 2], [(0, 2)])
    with pytest.raises(ValueError):
        Pattern.of([1], [(0, 0)])
    with pytest.raises(ValueError):
        Walk.read("0 1 : 0 1 : 0 0 : 1 : 0 : 1")


def test_files_round_trip(tmp_path):
    write_pattern_files(DIAMOND, str(tmp_path / "p"))
    assert read_pattern_files(str(tmp_path / "p")) == DIAMOND
    (tmp_path / "p" / "pattern_edge_data").write_text("1 0 9\n")
    assert read_pattern_files(str(tmp_path / "p")).weights == (9.0, None, None, None, None)
    d = Pattern.of([1, 2], [(1, 0)], directed=True)
    write_pattern_files(d, str(tmp_path / "d"))
    got = read_pattern_files(str(tmp_path / "d"), directed=True)
    assert got == d and (got.out_degree(1), got.in_degree(1), got.out_degree(0)) == (1, 0, 0)
    assert len(write_prototypes(DIAMOND, 1, str(tmp_path / "k"))) == 5


def test_shape():
    assert CYCLE.need() == [(0, 7, 1), (0, 22, 1), (1, 4, 1), (1, 7, 1), (2, 7, 1), (2, 22, 1), (3, 4, 1), (3, 7, 1)]
    assert (CYCLE.diameter(), BRANCH.diameter()) == (2, 3)
    assert CYCLE.cycles() == [(0, 1, 2, 3)]
    assert DIAMOND.cycles() == [(0, 1, 2), (1, 2, 3), (0, 1, 3, 2)]
    assert DIAMOND.merged_cycles() == [frozenset(DIAMOND.edges)] and CYCLE.merged_cycles() == []
    assert DIAMOND.shortest_path(0, 3) == [0, 1, 3]
    assert not Pattern.of([1, 2, 3], [(0, 1)]).connected()
    assert [len(CYCLE.prototypes(k)) for k in (1, 2)] == [4, 0]
    assert [len(DIAMOND.prototypes(k)) for k in (1, 2, 3)] == [5, 8, 0]


@pytest.mark.parametrize("p", [CYCLE, BRANCH, DIAMOND])
def test_covering_walk_uses_query_edges_only(p):
    for start in range(p.n):
        walk = p.covering_walk(start)
        steps = {tuple(sorted(s)) for s in zip(walk, walk[1:])}
        assert steps == set(p.edges)
        assert Walk(tuple(walk), walk[0] == walk[-1]).covers(p)


def test_constraints():
    assert [w.vertices for w in constraints.generate(CYCLE)][0] == (0, 1, 2, 3, 0)
    assert {w.cyclic for w in constraints.generate(DIAMOND, "all")} == {True, False}
    assert any(w.search for w in constraints.generate(DIAMOND, "all"))
    assert constraints.generate(BRANCH) == [] == constraints.generate(CYCLE, "none")
    assert constraints.generate(DIAMOND, "random", seed=4) == constraints.generate(DIAMOND, "random", seed=4)
    first = constraints.generate(DIAMOND, counts={0: 9, 1: 1, 2: 5}, part=0.25)
    assert [w.vertices[0] for w in first] == [1]
    path = constraints.path_walk(Pattern.of([5, 1, 5], [(0, 1), (1, 2)]), 0)
    assert path == Walk((0, 1, 2), cyclic=False)


def test_orders():
    assert constraints.vf3_order(BRANCH, [0.5, 0.1, 0.4, 0.2]) == [1, 0, 3, 2] or constraints.vf3_order(BRANCH, [0.5, 0.1, 0.4, 0.2])[0] == 1
    assert constraints.size_order(DIAMOND, {0: 5, 1: 9, 2: 8, 3: 2})[0] == 3
    assert constraints.extensions(DIAMOND, [3, 2, 1, 0]) == [[], [3], [3, 2], [2, 1]]
    assert constraints.parents(DIAMOND, [3, 2, 1, 0]) == {3: None, 2: 3, 1: 3, 0: 2}
    assert constraints.levels(BRANCH, [0, 1, 2, 3]) == [{2: [1], 4: [3]}, {3: [2], 4: [3]}, {4: [3]}, {}]
    assert constraints.rarity(BRANCH, {1: 5, 2: 10}, {2: 4, 1: 8}, 10) == [0.5 * 0.4, 1.0 * 0.4, 0.0, 0.0]


def test_weights_follow_their_edges():
    p = read_pattern(["v 0 1", "v 1 2", "v 2 3", "e 0 1 5", "e 1 0 7", "e 1 2 9", "c diameter : 2"])
    assert p.edges == ((0, 1), (1, 2)) and p.weights == (5.0, 9.0) and p.constraints == ()
    again = read_pattern(write_pattern(p, constraints=[Walk((0, 1, 2), cyclic=False)]).splitlines())
    assert (again.edges, again.weights) == (p.edges, p.weights) and [Walk.read(c).vertices for c in again.constraints] == [(0, 1, 2)]
    assert p.prototype_count(1) == 2
