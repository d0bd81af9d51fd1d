import random

import pytest

from latticework.llm import mixing
from latticework.llm.mixing import mix

TARGETS = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("gone", 0.1, 3)]


def tables(spark, n=3000, seed=1, targets=TARGETS):
    rng = random.Random(seed)
    pick = lambda: (r := rng.random()) and ("a" if r < 0.6 else "b" if r < 0.65 else "c" if r < 0.9 else None if r < 0.95 else "other")
    rows = [(i, pick(), None if rng.random() < 0.02 else "x " * rng.randrange(60), 5) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, source string, text string, h int")
    return rows, df, spark.createDataFrame(targets, "source string, share double, max_repeat int")


@pytest.mark.parametrize("step", [10, 2])
def test_shares(spark, monkeypatch, step):
    monkeypatch.setattr(mixing, "STEP", step)
    rows, df, targets = tables(spark)
    chosen, shares = mix(df, targets, "id", "text", "source")
    chosen, shares = chosen.collect(), {r.source: r for r in shares.collect()}
    used = {s: sum(r.n_tokens * r.repeats for r in chosen if r.source == s) for s in "abc"}
    total = sum(used.values())
    for s, share, most in TARGETS[:3]:
        mine = [r for r in chosen if r.source == s]
        assert max(r.repeats for r in mine) <= most
        assert max(r.repeats for r in mine) - min(r.repeats for r in mine) <= 1
        assert abs(used[s] / total - share) < 100 / total
        assert shares[s].used_tokens == used[s] and abs(shares[s].actual_share - used[s] / total) < 1e-12
    assert shares["gone"].actual_share == 0 and {r.source for r in chosen} == {"a", "b", "c"}
    assert len({r.doc_id for r in chosen}) == len(chosen)


def test_smaller_budgets_are_nested(spark):
    _, df, targets = tables(spark)
    last = {}
    for total in (500, 5_000, 20_000):
        chosen = {r.doc_id: r for r in mix(df, targets, "id", "text", "source", total)[0].collect()}
        used = sum(r.n_tokens * r.repeats for r in chosen.values())
        assert total - 400 < used <= total
        assert all(chosen[i].repeats >= r.repeats for i, r in last.items())
        last = chosen


def test_more_than_there_is(spark):
    rows, df, targets = tables(spark, 200)
    chosen, shares = mix(df, targets, "id", "text", "source", 10**9)
    assert all(r.repeats == {"a": 1, "b": 4, "c": 2}[r.source] for r in chosen.collect())


def test_empty_and_repeated_ids(spark):
    _, df, targets = tables(spark, 300)
    chosen, shares = mix(df.limit(0), targets, "id", "text", "source")
    assert chosen.count() == 0 and {r.actual_share for r in shares.collect()} == {None}
    assert mix(df, targets.limit(0), "id", "text", "source")[0].count() == 0
    same = spark.createDataFrame([(7, "a", "x x x", 0)] * 20 + [(i, "c", "y", 0) for i in range(20)], df.schema)
    assert sum(r.repeats for r in mix(same, targets, "id", "text", "source", 30)[0].where("source = 'a'").collect()) in (0, 20)
