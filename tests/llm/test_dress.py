import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from latticework.llm import dress
from latticework.llm.dress import Collapsed, edge_form


def form(spark, *lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    return [r.f for r in df.orderBy("i").select(edge_form("line").alias("f")).collect()]


SAME = [
    ["12 34 1.5", "34,12,1.5", "12->34 : 1.5", "t=34 w=1.5 s=12", "{\"S\": \"12\", \"W\": \"1.5\", \"T\": \"34\"}", "<t>34</t> <s>12</s> <w>1.5</w> ;", "( '12' | '34' | '1.5' )\r"],
    ["0x1A0b 7", "0X1a0B 7", "7 -- 0x1a0b", "s: 7; t: 0X1A0B"],
    ["1_234 5'678 1e+5", "1234;5678;1E+5"],
    ["1 2 -3", "1\t2\t-3", "w=-3|t=1|s=2", "1->2,-3"],
]
DIFFERENT = ["1 2", "1 2 3", "1 2 -3", "1 2 +3", "1 2 3.0", "1 2 03", "1 2 1.5", "1 2 15", "1 2 1.50", "1 2 1,5 x", "12", "01 2", "0x1 2", "no edge", "no  edge", "", None]


@pytest.mark.parametrize("lines", SAME)
def test_same(spark, lines):
    assert len(set(form(spark, *lines))) == 1


def test_different(spark):
    got = form(spark, *DIFFERENT)
    assert len(set(got)) == len(DIFFERENT)
    assert all(f is not None for f in got)


def pairs(rows, forms):
    by = defaultdict(list)
    for (i, _), f in zip(rows, forms):
        by[f].append(i)
    return sorted((min(g), i) for g in by.values() for i in g if i != min(g))


@pytest.mark.parametrize("hot", [0.001, 0.3])
def test_copies(spark, monkeypatch, hot):
    rng = random.Random(3)
    rows = [(i, rng.choice(["1 2", "2,1"]) if rng.random() < 0.4 else f"{rng.randrange(9)} {rng.randrange(9)} {rng.randrange(3)}") for i in range(3000)] + [(4000, None), (4001, None), (4002, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "rec_id long, line string, h1 int, first_id int")
    forms = [r.f for r in df.select("rec_id", edge_form("line").alias("f")).collect()]
    c = Collapsed(df, "rec_id", edge_form("line"))
    assert sorted(map(tuple, c.copies(hot).collect())) == pairs(rows, forms)
    assert sum(r.copies for r in c.groups.collect()) == len(rows)
    assert Collapsed(df.limit(0), "rec_id", edge_form("line")).copies().count() == 0


def test_clashes_are_resolved(spark, monkeypatch):
    real = dress._with_hashes
    monkeypatch.setattr(dress, "_with_hashes", lambda *a: real(*a).withColumn("h1", F.lit(0)).withColumn("h2", F.length("form") % 2))
    rows = [(i, f"{i % 5} {i % 3 + 10}") for i in range(60)]
    df = spark.createDataFrame(rows, "rec_id long, line string")
    c = Collapsed(df, "rec_id", edge_form("line"))
    assert sorted(map(tuple, c.copies().collect())) == pairs(rows, [r.f for r in df.select(edge_form("line").alias("f")).collect()])
    assert c.groups.count() == 15
