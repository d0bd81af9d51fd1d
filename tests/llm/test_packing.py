import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import packing
from latticework.llm.packing import contents, fill, fullest, pack, plan
from latticework.llm.tokens import VOCABULARY, encoding, token_counts


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 40))
@settings(max_examples=300, deadline=None)
def test_fullest_is_the_best_with_the_largest(counts, more):
    sizes = sorted(counts, reverse=True)
    capacity = sizes[0] + more
    chosen = fullest(counts, sizes, capacity)
    sums = {sizes[0]}
    items = [s for s in sizes for _ in range(counts[s])][1:]
    for s in items:
        sums |= {x + s for x in sums if x + s <= capacity}
    assert all(chosen[s] <= counts[s] for s in chosen) and chosen[sizes[0]] >= 1
    assert sum(s * k for s, k in chosen.items()) == max(sums)


def test_plan_uses_every_size_once():
    rng = random.Random(1)
    counts = {s: rng.randrange(1, 50) for s in range(1, 300)}
    held, used = Counter(), defaultdict(list)
    for size, lo, hi, base, each in plan(counts, 256 * 2):
        used[size].append((lo, hi))
        for r in range(lo, hi):
            held[base + (r - lo) // each] += size
    for size, ranges in used.items():
        assert sorted(ranges)[0][0] == 0 and sorted(ranges)[-1][1] == counts[size]
        assert all(a[1] == b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:]))
    assert max(held.values()) <= 512 and sorted(held) == list(range(len(held)))
    assert len(held) <= -(-sum(s * n for s, n in counts.items()) // 512) + 2


@pytest.mark.parametrize("group_rows", [50_000, 100])
def test_pack(spark, monkeypatch, group_rows):
    monkeypatch.setattr(packing, "GROUP_ROWS", group_rows)  # small groups: ranks need the groups' offsets
    rng = random.Random(2)
    words = ["int ", "return x;", "\n\n", "é", "点線", "   ", "foo_bar(1)"]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), 0) for i in range(700)] + [(1000, None, 0), (1001, "", 0), (1002, "word " * 1000, 0), (1003, "same", 0), (1004, "same", 0)]
    df = spark.createDataFrame(rows, "id long, text string, size int")
    encode = encoding(VOCABULARY).encode_ordinary
    lengths = {i: len(encode(t)) if t else 0 for i, t, _ in rows}
    got = pack(df, "id", "text", 128).collect()
    pieces, held = defaultdict(list), Counter()
    for r in got:
        pieces[r.doc_id].append((r.first_token, r.n_tokens))
        if r.container is not None:
            held[r.container] += r.n_tokens
    assert set(pieces) == set(lengths)
    for i, some in pieces.items():
        some.sort()
        assert sum(n for _, n in some) == lengths[i]
        assert all(a[0] + a[1] == b[0] for a, b in zip(some, some[1:])) and some[0][0] == 0
        assert len(some) == max(1, -(-lengths[i] // 128))
    assert all(r.container is None for r in got if r.doc_id in (1000, 1001))
    assert max(held.values()) <= 128 and sorted(held) == list(range(len(held)))
    assert len(held) <= -(-sum(lengths.values()) // 128) * 1.02 + 1
    assert {r.container: (r.n_tokens, r.slack) for r in fill(pack(df, "id", "text", 128), 128).collect()} == {c: (n, 128 - n) for c, n in held.items()}


def test_contents_give_the_texts_again(spark):
    rows = [(1, "点線" * 300, 0), (2, None, 0), (3, "", 0), (4, "short", 0), (5, "a b\n" * 500, 0)]
    df = spark.createDataFrame(rows, "id long, text string, part int")
    got = contents(df, "id", "text", pack(df, "id", "text", 64)).collect()
    for i, t, _ in rows:
        parts = sorted((r.part, r.content) for r in got if r.doc_id == i)
        assert (t is None and parts == [(0, None)]) or b"".join(bytes(c) for _, c in parts) == t.encode()
    assert max(sum(r.doc_id in (1, 5) for r in got if r.container == c) for c in {r.container for r in got}) >= 1
    assert contents(df.limit(0), "id", "text", pack(df.limit(0), "id", "text", 64)).count() == 0


def test_nothing_to_pack(spark):
    df = spark.createDataFrame([(1, None)], "id long, text string")
    assert [tuple(r) for r in pack(df, "id", "text", 8).collect()] == [(None, 1, 0, 0, 0)]
    assert pack(df.limit(0), "id", "text", 8).count() == 0
    with pytest.raises(ValueError):
        pack(df, "id", "text", 0)


def test_special_tokens_are_text(spark):
    df = spark.createDataFrame([(1, "<|endoftext|>")], "id long, text string")
    assert token_counts(df, "text", ["id"]).first().n_tokens > 1
