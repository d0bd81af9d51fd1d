"""Results per key where a handful of keys holds most rows.

Rows are range-partitioned by the composite (key, neighbour, tie), with the quantiles of Spark's sample. A frequent key
is thereby split over as many partitions as its rows need, and even copies of one (key, neighbour) pair are split by
the tie; other keys share partitions. Each partition scans its sorted rows once and leaves one partial state per key.
Only a partition's first and last key can go on in another one: the states of such a key are stitched in partition
order, where a neighbour that ends one state and starts the next is counted once. Several (key, neighbour) columns of
one table are done together, so the table is read once for the sample and once for the rows.

Defined results: rows without a key are left out; a missing neighbour counts as a row, not as a neighbour; a
missing weight is left out of the sum, which is null where no row has one. Sums are of doubles in no fixed
order: round them before comparing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts into which the rows of one (key, neighbour) pair may be split.
TIES = 1 << 16
#: Rows that a range partition should have at most.
PARTITION_ROWS = 4_000_000


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the row before, in any of the columns (a null is like a null)."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if c.null_count:
            differ = differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
        new[1:] |= differ
    return new


def _states(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One state per (side, key) of a partition sorted by (key, side, neighbour); a state may go on in the next batch.

    Input: side, key, neighbour, weight. The states of a batch are made by whole columns; only its first and last,
    which may be parts, are handled one by one.
    """
    part = TaskContext.get().partitionId()
    open_: list | None = None  # side, key, rows, neighbours, weight, weights, first neighbour, last neighbour

    def one(state: list) -> pa.RecordBatch:
        row = [*state[:2], part, *state[2:]]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        side, key, nbr, w = (b.column(i) for i in range(4))
        at = np.flatnonzero(_starts(side, key))
        ends = np.append(at[1:], b.num_rows)
        seen = nbr.is_valid().to_numpy(zero_copy_only=False)
        weighs = w.is_valid().to_numpy(zero_copy_only=False)
        values = np.where(weighs, w.fill_null(0).to_numpy(zero_copy_only=False), 0.0)
        fresh = (_starts(side, key, nbr) & seen).astype(np.int64)
        nbrs, sums, weights, some = (np.add.reduceat(x, at) for x in (fresh, values, weighs.astype(np.int64), seen.astype(np.int64)))
        head = np.where(some > 0, ends - some, ends - 1)  # missing neighbours come first

        def state(i: int) -> list:
            lo, hi = int(at[i]), int(ends[i])  # noqa: B023
            known = int(some[i])  # noqa: B023
            return [side[lo].as_py(), key[lo].as_py(), hi - lo, int(nbrs[i]), float(sums[i]), int(weights[i]), nbr[int(head[i])].as_py() if known else None, nbr[hi - 1].as_py()]  # noqa: B023

        begins = state(0)
        if open_ is not None and open_[:2] == begins[:2]:
            same = begins[6] is not None and begins[6] == open_[7]
            open_ = [*open_[:2], open_[2] + begins[2], open_[3] + begins[3] - same, open_[4] + begins[4], open_[5] + begins[5],
                     begins[6] if open_[6] is None else open_[6], open_[7] if begins[7] is None else begins[7]]
        else:
            if open_ is not None:
                yield one(open_)
            open_ = begins
        if len(at) == 1:
            continue
        yield one(open_)
        if len(at) > 2:
            mid = slice(1, len(at) - 1)
            lo, hd, tl = pa.array(at[mid]), pa.array(head[mid]), pa.array(ends[mid] - 1)
            n = len(lo)
            whole = [side.take(lo), key.take(lo), pa.array(np.full(n, part), pa.int32()), pa.array(ends[mid] - at[mid]), pa.array(nbrs[mid]),
                     pa.array(sums[mid]), pa.array(weights[mid]), nbr.take(hd), nbr.take(tl)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(whole, schema)], schema=schema)
        open_ = state(len(at) - 1)
    if open_ is not None:
        yield one(open_)


def _ranged(rows: DataFrame, n: int) -> DataFrame:
    """rows by ranges; as many as the session says, or as n rows need."""
    order = ("k", "side", "n", "tie_")
    parts = -(-n // PARTITION_ROWS)
    known = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order) if parts > known else rows.repartitionByRange(*order)


def totals(df: DataFrame, sides: Sequence[tuple[str, str]], weight: str, tie: str) -> DataFrame:
    """(side, k, n_rows, n_neighbours, sum_weight) for each (key, neighbour) of ``sides`` and every key that is not null.

    side is the key column's name. tie: a column that tells rows of one (key, neighbour) apart, such as the row's id.
    """
    both = F.array(*(F.struct(F.lit(i).cast("byte").alias("side"), F.col(k).alias("k"), F.col(n).alias("n")) for i, (k, n) in enumerate(sides)))
    rows = df.select(F.explode(both).alias("e"), F.col(weight).cast("double").alias("w"), F.pmod(F.xxhash64(tie), F.lit(TIES)).cast("int").alias("tie_"))
    rows = rows.select("e.side", "e.k", "e.n", "w", "tie_").where(F.col("k").isNotNull())
    kind, other = rows.schema["k"].dataType, rows.schema["n"].dataType
    out = T.StructType([
        T.StructField("side", T.ByteType()), T.StructField("k", kind), T.StructField("part", T.IntegerType()), T.StructField("rows", T.LongType()),
        T.StructField("nbrs", T.LongType()), T.StructField("w", T.DoubleType()), T.StructField("ws", T.LongType()),
        T.StructField("first", other), T.StructField("last", other),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)
    states = (
        _ranged(rows, df.count() * len(sides)).drop("tie_").sortWithinPartitions("k", "side", "n")
        .mapInArrow(lambda it: _states(it, schema), out)
    )
    w = Window.partitionBy("side", "k").orderBy("part")  # a key has a state per partition it stands in
    last = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    stitched = states.withColumn("again", F.coalesce((last == F.col("first")).cast("long"), F.lit(0)))
    name = F.element_at(F.array(*(F.lit(k) for k, _ in sides)), F.col("side") + 1).alias("side")
    return stitched.groupBy("side", "k").agg(
        F.sum("rows").alias("n_rows"), (F.sum("nbrs") - F.sum("again")).alias("n_neighbours"),
        F.when(F.sum("ws") > 0, F.sum("w")).alias("sum_weight"),
    ).select(name, "k", "n_rows", "n_neighbours", "sum_weight")


def keyed_totals(df: DataFrame, key: str, neighbour: str, weight: str, tie: str) -> DataFrame:
    """(k, n_rows, n_neighbours, sum_weight) for every key of df that is not null."""
    return totals(df, [(key, neighbour)], weight, tie).drop("side")
