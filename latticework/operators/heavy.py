"""Finding the keys that would make one task slow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 200_000


def heavy_keys(df: DataFrame, key: str, share: float = 0.002, sample_rows: int = SAMPLE_ROWS) -> list:
    """Keys that seem to hold at least ``share`` of the rows, by a seeded sample of about ``sample_rows`` rows.

    Only the plan depends on it (which rows take the route for heavy keys), never a result. At most 1/share
    keys come back, whatever the size of df. Null keys are not returned.
    """
    keyed = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    n = keyed.count()
    if not n:
        return []
    fraction = min(1.0, sample_rows / n)
    sample = keyed if fraction == 1.0 else keyed.sample(fraction, seed=7)
    least = max(2, int(share * n * fraction))
    found = sample.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return [r.k for r in found.orderBy(F.desc("n"), "k").limit(int(1 / share)).collect()]
