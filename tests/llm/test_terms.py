import random
from collections import Counter, defaultdict

import pytest

from latticework.llm import terms
from latticework.llm.terms import mark, run_counts, term_counts


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_like_counting(spark, many_partitions, seed):
    rng = random.Random(seed)
    rows = [(i, None if rng.random() < 0.1 else 5 if rng.random() < 0.4 else rng.randrange(30), None if rng.random() < 0.1 else 1 if rng.random() < 0.4 else rng.randrange(50), 0) for i in range(3000)]
    n, recs = Counter(), defaultdict(set)
    for _, term, rec, _ in rows:
        if term is not None:
            n[term] += 1
            recs[term] |= {rec} - {None}
    df = spark.createDataFrame(rows, "tie long, g1 long, record long, n int").repartition(3)
    for tie in ("tie", None):
        got = {r.term: (r.n, r.n_records) for r in term_counts(df, "g1", "record", tie).collect()}
        assert got == {t: (n[t], len(recs[t])) for t in n}


def runs_by_counting(rows, longest=None):
    """{run: (occurrences, records)} of all runs; rows: (sequence, record, terms)."""
    n, recs = Counter(), defaultdict(set)
    for _, rec, seq in rows:
        seq = [t for t in seq or [] if t is not None]
        for k in range(1, min(len(seq), longest or len(seq)) + 1):
            for i in range(len(seq) - k + 1):
                n[tuple(seq[i : i + k])] += 1
                recs[tuple(seq[i : i + k])] |= {rec} - {None}
    return {r: (n[r], len(recs[r])) for r in n if n[r] > 1 or len(r) == 1 or n[r[:-1]] > 1}


def as_table(spark, rows):
    flat = [(s, rec, i, t, "x") for s, rec, seq in rows for i, t in enumerate(seq or [])]
    return spark.createDataFrame(flat, "seq long, rec long, at int, word string, place string").repartition(3)


@pytest.mark.parametrize("seed,longest,window", [(1, None, 16), (2, None, 3), (3, 2, 16), (4, 5, 2)])
def test_runs_like_counting(spark, many_partitions, monkeypatch, seed, longest, window):
    monkeypatch.setattr(terms, "WINDOW", window)
    rng = random.Random(seed)
    rows = [(i, rng.randrange(12), None if i == 7 else [rng.choice(["a", "b", "c", "a b"]) for _ in range(rng.randrange(9))]) for i in range(40)]
    rows += [(90, 90, ["a"] * 12), (91, 91, ["a", None, "b"]), (92, 3, ["q", "r", "s", "t", "u", "v"]), (93, 93, ["q", "r", "s", "t", "u", "w"]), (94, None, ["z", "a"])]
    got = run_counts(as_table(spark, rows), "rec", "word", ["at"], "seq", longest).collect()
    want = runs_by_counting(rows, longest)
    assert {tuple(r.run): (r.n, r.n_records) for r in got} == want
    assert len(got) == len(want) and all(len(r.run) == r.length for r in got)


def test_rows_without_a_record_and_empty(spark):
    rows = [(1, 1, ["a", "b"]), (None, None, ["a", "b"]), (2, 1, ["a", "b"])]
    got = run_counts(as_table(spark, rows), "rec", "word", ["at"]).collect()
    assert {tuple(r.run): (r.n, r.n_records) for r in got} == {("a",): (3, 1), ("b",): (3, 1), ("a", "a"): (1, 1), ("a", "b"): (1, 1), ("b", "b"): (1, 1)}
    assert run_counts(as_table(spark, rows).limit(0), "rec", "word", ["at"]).count() == 0


def test_empty_and_marks(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 1), (2, 2), (2, 2), (3, None)] + [(4, i) for i in range(3)], "l long, a long")
    assert term_counts(df.limit(0), "l", "a").count() == 0
    got = term_counts(df, "l", "a")
    assert {r.term: r.m for r in got.select("term", mark(got, 40, 2, 0.25).alias("m")).collect()} == {1: "common", 2: "rare", 3: None, 4: None}
