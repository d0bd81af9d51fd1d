"""Written tables, and what is sent to the workers."""

import gc
import os
import time

from pyspark.sql import functions as F

from latticework import session
from latticework.operators.traverse import components
from latticework.session import counted, cut, ship, stored
from graphs import graph


def test_a_stored_table_stays_while_it_is_read(spark):
    a = stored(spark.range(100).withColumn("x", F.col("id") % 7))
    folder = session._tables[-1][0].removeprefix("file:")
    b = a.where("x = 3")
    del a
    gc.collect()
    spark._jvm.System.gc()
    session._sweep(spark)
    assert os.path.isdir(folder) and b.count() == 14
    del b
    for _ in range(40):  # deleted once the JVM has let its last plan go
        gc.collect()
        spark._jvm.System.gc()
        stored(spark.range(3)).count()
        if not os.path.isdir(folder):
            break
        time.sleep(0.2)
    assert not os.path.isdir(folder)


def test_a_cut_table_stays_partitioned(spark):
    a = cut(spark.range(1000).repartition(4, "id"))
    plan = a.join(spark.range(50), "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    assert counted(a, 10**9) is a


def test_the_package_is_sent_once(spark):
    ship(spark)
    before = list(spark.sparkContext._python_includes)
    ship(spark)
    assert spark.sparkContext._python_includes == before and "latticework.zip" in before
    names = spark.range(2).rdd.map(lambda _: __import__("latticework.operators.rowparse", fromlist=["x"]).__name__).collect()
    assert set(names) == {"latticework.operators.rowparse"}


def test_components_of_shapes_that_ids_alone_contract_slowly(spark):
    star = [(1000, i) for i in range(60)]
    comb = [(i, i + 1) for i in range(200, 260)] + [(i, 2000 - i) for i in range(200, 261)]
    zigzag = [(300 + i, 900 - i) for i in range(40)] + [(900 - i, 301 + i) for i in range(39)]
    got = {r.id: r.cc for r in components(graph(spark, star + comb + zigzag)).collect()}
    assert {got[x] for e in star for x in e} == {0} and {got[x] for e in comb for x in e} == {200} and {got[x] for e in zigzag for x in e} == {300}
