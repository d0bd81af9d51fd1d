"""References to records that are missing, gone, or not there yet.

References come from several tables; a statement table says from when until when a key exists. References are counted
per key and moment before anything is joined (map-side combined, so a key on a third of the rows costs a few rows per
task) and these counts are written once. Then keys take one of three ways:

* heavy keys (by a bounded sample of the counts and of the statements) with few statements: a broadcast of these,
  at most NEAR_STATEMENTS for each of at most 2/share keys;
* all other keys: a shuffled anti-join, done as a merge. References and statements of a key are put in order of time,
  and a reference finds no record if the latest end of all statements so far isn't after it;
* heavy keys with more statements: the same merge, but a key is split into slices of time by sampled quantiles, and
  the latest end of a slice is carried to the next ones, so no key is bound to one task.

The orphans of the three are united. Rows come back by a semi-join on the orphaned (table, key, moment) groups, the
heavy ones of which (at most 1/share) are salted.

Defined results: a reference whose key is null refers to nothing and is left out; one whose moment is null can't be
covered by any statement and is an orphan without a period; a statement with a null key or start, or one that ends
before it starts, covers nothing; repeated statements count once, repeated references each. An orphan's cause is
``missing`` if no statement has its key, ``gone`` if one started before it, else ``early``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.heavy import heavy_keys
from latticework.session import stored

#: Statements of a heavy key that may be broadcast.
NEAR_STATEMENTS = 64
#: Slices of time into which keys with more statements are split.
SLICES = 256
#: Parts into which the rows of a heavy orphaned group are split when they are looked up.
SALTS = 64


@dataclass(frozen=True)
class Reference:
    """A table with references: its name in the report, the columns of the key, the moment and the row's id."""

    name: str
    rows: DataFrame
    key: str
    at: str
    row_id: str


_UP_TO = (Window.unboundedPreceding, Window.currentRow)
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
_BEFORE = (Window.unboundedPreceding, -1)


def _cause(any_statement: Column, any_before: Column) -> Column:
    return F.when(any_before, "gone").when(any_statement, "early").otherwise("missing").alias("cause")


class Orphans:
    """The orphaned references of some tables.

    groups: (tab, key_, at, n, cause), one row per table, key and moment whose n references find no record.
    """

    def __init__(self, references: Sequence[Reference], statements: DataFrame, key: str, start: str, end: str, share: float = 0.002):
        parts = [
            r.rows.where(F.col(r.key).isNotNull()).select(
                F.lit(r.name).alias("tab"), F.col(r.row_id).cast("long").alias("row_id"), F.col(r.key).alias("key_"), F.col(r.at).alias("at")
            )
            for r in references
        ]
        self._share = share
        self.rows = reduce(DataFrame.unionByName, parts)
        counts = stored(self.rows.groupBy("tab", "key_", "at").agg(F.count(F.lit(1)).alias("n")))
        moment = counts.schema["at"].dataType
        far = F.lit("9999-12-31 00:00:00").cast(moment)
        # A statement that ends before it starts has no moment for which its end is later than it.
        self._statements = statements.where(F.col(key).isNotNull() & F.col(start).isNotNull()).select(
            F.col(key).alias("key_"), F.col(start).cast(moment).alias("at"), F.coalesce(F.col(end).cast(moment), far).alias("until")
        )
        heavy = sorted({*heavy_keys(counts, "key_", share), *heavy_keys(self._statements, "key_", share)})
        near = self._near(heavy)
        wide = [k for k in heavy if k not in near]
        timed = counts.where(F.col("at").isNotNull())
        light = timed.where(~F.col("key_").isin(heavy)) if heavy else timed
        found = [self._merged(light, self._statements.where(~F.col("key_").isin(heavy)) if heavy else self._statements)]
        if near:
            found.append(self._checked(timed.where(F.col("key_").isin(list(near))), near))
        if wide:
            found.append(self._sliced(timed.where(F.col("key_").isin(wide)), self._statements.where(F.col("key_").isin(wide))))
        untimed = counts.where(F.col("at").isNull())
        if not untimed.isEmpty():
            known = self._statements.select("key_", F.lit(True).alias("any"))
            found.append(untimed.join(known.distinct(), "key_", "left").select("tab", "key_", "at", "n", _cause(F.col("any").isNotNull(), F.lit(False))))
        self.groups = stored(reduce(DataFrame.unionByName, found))

    def _near(self, heavy: list) -> dict:
        """The statements of each heavy key that has few: (start, end), repeated starts once."""
        if not heavy:
            return {}
        some = self._statements.where(F.col("key_").isin(heavy)).groupBy("key_", "at").agg(F.max("until").alias("until"))
        n = some.groupBy("key_").count()
        few = [r.key_ for r in n.where(F.col("count") <= NEAR_STATEMENTS).collect()]
        none = set(heavy) - {r.key_ for r in n.select("key_").collect()}
        near: dict = {k: [] for k in [*few, *none]}
        for r in some.where(F.col("key_").isin(few)).collect() if few else []:
            near[r.key_].append((r["at"], r.until))
        return near

    def _checked(self, counts: DataFrame, near: dict) -> DataFrame:
        """Heavy keys against a broadcast of their few statements."""
        kinds = {f.name: f.dataType.simpleString() for f in self._statements.schema}
        rows = [(k, [{"since": a, "until": b} for a, b in some]) for k, some in near.items()]
        small = counts.sparkSession.createDataFrame(rows, f"key_ {kinds['key_']}, known array<struct<since:{kinds['at']},until:{kinds['until']}>>")
        both = counts.join(F.broadcast(small), "key_")
        live = F.exists("known", lambda s: (s["since"] <= F.col("at")) & (s["until"] > F.col("at")))
        before = F.exists("known", lambda s: s["since"] <= F.col("at"))
        return both.where(~live).select("tab", "key_", "at", "n", _cause(F.size("known") > 0, before))

    @staticmethod
    def _events(counts: DataFrame, statements: DataFrame) -> DataFrame:
        """References and statements in one table; at one moment statements come first."""
        states = statements.select("key_", "at", F.lit(0).alias("kind"), "until")
        return states.unionByName(counts.select("key_", "at", F.lit(1).alias("kind"), "tab", "n"), allowMissingColumns=True)

    def _merged(self, counts: DataFrame, statements: DataFrame) -> DataFrame:
        w = Window.partitionBy("key_")
        e = self._events(counts, statements)
        e = e.withColumn("reach", F.max("until").over(w.orderBy("at", "kind").rowsBetween(*_UP_TO)))
        e = e.withColumn("any", F.min("kind").over(w) == 0)
        orphan = (F.col("kind") == 1) & (F.col("reach").isNull() | (F.col("reach") <= F.col("at")))
        return e.where(orphan).select("tab", "key_", "at", "n", _cause(F.col("any"), F.col("reach").isNotNull()))

    def _sliced(self, counts: DataFrame, statements: DataFrame) -> DataFrame:
        e = self._events(counts, statements.groupBy("key_", "at").agg(F.max("until").alias("until")))
        e = stored(e)
        seen = e.select(F.col("at").cast("timestamp").cast("double").alias("x"))
        n = seen.count()
        sample = sorted(r.x for r in seen.sample(min(1.0, 100_000 / max(n, 1)), seed=7).limit(200_000).collect())
        bounds = sorted({sample[i * len(sample) // SLICES] for i in range(1, SLICES)}) if sample else []
        e = e.withColumn("slice", _slice(F.col("at").cast("timestamp").cast("double"), bounds))
        ends = e.groupBy("key_", "slice").agg(F.max("until").alias("top"))  # at most SLICES rows for a key
        w = Window.partitionBy("key_").orderBy("slice")
        ends = ends.select(
            "key_", "slice", F.max("top").over(w.rowsBetween(*_BEFORE)).alias("carried"),
            F.max("top").over(w.rowsBetween(*_ALL)).isNotNull().alias("any"),
        )
        here = Window.partitionBy("key_", "slice").orderBy("at", "kind").rowsBetween(*_UP_TO)
        e = e.withColumn("here", F.max("until").over(here)).join(ends, ["key_", "slice"])
        e = e.withColumn("reach", F.greatest("here", "carried"))
        orphan = (F.col("kind") == 1) & (F.col("reach").isNull() | (F.col("reach") <= F.col("at")))
        return e.where(orphan).select("tab", "key_", "at", "n", _cause(F.col("any"), F.col("reach").isNotNull()))

    def report(self) -> DataFrame:
        """(tab, yyyymm, n_refs, n_keys, n_missing, n_gone, n_early) per table and month."""
        month = (F.year("at") * 100 + F.month("at")).alias("yyyymm")
        of = lambda c: F.coalesce(F.sum(F.when(F.col("cause") == c, F.col("n"))), F.lit(0)).alias(f"n_{c}")
        causes = ("missing", "gone", "early")
        by_key = self.groups.groupBy("tab", "key_", month).agg(F.sum("n").alias("n"), *map(of, causes))
        sums = [F.sum(f"n_{c}").alias(f"n_{c}") for c in causes]
        return by_key.groupBy("tab", "yyyymm").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_keys"), *sums)

    def found(self) -> DataFrame:
        """(tab, row_id, yyyymm), one row per orphaned reference."""
        groups = self.groups.select("tab", "key_", "at", "n")
        total = groups.agg(F.sum("n")).first()[0] or 0
        is_hot = F.col("n") >= max(1000, self._share * total)
        hot = groups.where(is_hot).drop("n").collect()  # at most 1/share
        groups = groups.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        near = groups.sparkSession.createDataFrame([(*r, True) for r in hot], groups.drop("n", "salt").withColumn("hot", F.lit(True)).schema)
        same = lambda a, b: (F.col(f"{a}.tab") == F.col(f"{b}.tab")) & (F.col(f"{a}.key_") == F.col(f"{b}.key_")) & F.col(f"{a}.at").eqNullSafe(F.col(f"{b}.at"))
        rows = self.rows.alias("r").join(F.broadcast(near).alias("h"), same("r", "h"), "left")
        rows = rows.select("r.*", F.when(F.col("hot"), F.pmod(F.xxhash64("row_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt"))
        out = rows.alias("r").join(groups.drop("n").alias("o"), same("r", "o") & (F.col("r.salt") == F.col("o.salt")), "left_semi")
        return out.select("tab", "row_id", (F.year("at") * 100 + F.month("at")).cast("int").alias("yyyymm"))


def _slice(x: Column, bounds: list[float]) -> Column:
    """How many of the bounds, which are in order, x has reached; by halving."""
    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x >= bounds[mid], among(mid + 1, hi)).otherwise(among(lo, mid))

    return among(0, len(bounds))
