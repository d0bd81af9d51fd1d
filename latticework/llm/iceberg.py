"""The values that hold at least a given part of a column, with bounded memory.

Every value falls into one bucket under each of several hashes. One pass counts the buckets exactly; a bucket's
count is an upper bound for each of its values, so a value whose bucket stays below the threshold under any hash
can't be frequent. A second pass keeps the rows whose every bucket reaches the threshold and counts these few
values exactly. Memory is ``hashes * buckets`` counters, however many values there are; the filter is a bit for each.

Results are exact for every share. Below about 1/MOST_BUCKETS most buckets reach the threshold; then the filter keeps
more, and the second pass counts more values, which spills as every aggregation does.

Defined results: nulls are no value and don't count towards the share; a value that holds exactly the share is
in; an empty column gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BUCKETS = 1 << 18


def _bucket(column: str, i: int, buckets: int) -> Column:
    return F.xxhash64(F.lit(i), F.col(column)).bitwiseAND(buckets - 1).cast("int")


def _is_set(bits: np.ndarray, at: Column) -> Column:
    """Whether the bit at a place is set; the bits are a literal of one long for 64 of them."""
    words = np.packbits(np.pad(bits, (0, -len(bits) % 64)), bitorder="little").view(np.int64)
    if not words.any():
        return F.lit(False)
    return F.getbit(F.get(F.array(*(F.lit(int(w)).cast("long") for w in words)), F.shiftright(at, 6)), at.bitwiseAND(63)) == 1


def frequent_values(df: DataFrame, column: str, share: float, hashes: int = 4, buckets: int = 0) -> DataFrame:
    """(value, n, at_most): each value on at least ``share`` of the rows with a value, its count, and the count of
    the smallest of its buckets, which bounded it after the first pass.

    buckets: counters per hash, a power of two; by default 8/share rounded up, 4096 at least.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    buckets = buckets or min(MOST_BUCKETS, max(4096, 1 << math.ceil(math.log2(8 / share))))
    if buckets & (buckets - 1) or buckets > MOST_BUCKETS:
        raise ValueError(f"buckets must be a power of two up to {MOST_BUCKETS}")
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    cells = F.array(*((_bucket("value", i, buckets) + i * buckets) for i in range(hashes)))
    counted = rows.select(F.explode(cells).alias("cell")).groupBy("cell").count().toArrow()
    counts = np.zeros(hashes * buckets, dtype=np.int64)
    counts[counted["cell"].to_numpy()] = counted["count"].to_numpy()
    total = int(counts[:buckets].sum())
    least = max(1, math.ceil(share * total - 1e-9))
    kept = rows
    for i in range(hashes):
        kept = kept.where(_is_set(counts[i * buckets : (i + 1) * buckets] >= least, _bucket("value", i, buckets)))
    found = kept.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    full = np.flatnonzero(counts >= least)
    bounds = df.sparkSession.createDataFrame([(int(c), int(counts[c])) for c in full], "cell int, bound long")  # at most hashes * buckets
    return found.withColumn("cell", F.explode(cells)).join(F.broadcast(bounds), "cell").groupBy("value", "n").agg(F.min("bound").alias("at_most"))
