"""How often each term, or run of terms, occurs, and in how many records: by the intervals of a sorted suffix array.

All terms, in the order of their records, are one text; every place in it begins a suffix that ends with its record.
The suffixes are sorted term by term: in each round those that share a run so far are range-partitioned by (run, next
term, record, tie) with Spark's sampled quantiles and sorted. The suffixes with a common prefix are then an interval of
the array; its length is the number of occurrences of that run. Records are counted by subtracting the adjacencies of
two suffixes of one record within the interval, which is sorted by record. Intervals that cross a partition's boundary
are stitched from their partial counts; so a term on a third of all rows is spread over many tasks, whatever record
it is in. Only suffixes in intervals of two or more go on to the next term, until none is left: there is no longest run.

Terms ahead come from windows of the text, WINDOW terms at a time, so the text isn't read in every round.

Defined results: a null term is no term. A term on a row without a record occurs there, in no record and in no longer
run. A record may stand on any number of rows. All runs that occur twice or more come out, and of those that occur
once the shortest: what is longer and begins with it occurs once, too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from latticework.session import counted, stored

#: Terms ahead that a suffix carries until they are looked up again.
WINDOW = 16


def _differs(*columns: pa.Array) -> np.ndarray:
    """Whether a row is unlike the row before it in any of the columns; the first is."""
    out = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if c.null_count:
            unlike = unlike | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
        out[1:] |= unlike
    out[:1] = True
    return out


def _intervals(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The intervals of one partition's suffixes (run, term, record), sorted so, or what the partition holds of them.

    Whole intervals of a batch are made by columns; its first and last may be parts and are handled one by one.
    """
    part = TaskContext.get().partitionId()
    open_: list | None = None  # run, term, occurrences, duplicates, without a record, first and last record

    def one(state: list) -> pa.RecordBatch:
        row = [*state[:2], part, *state[2:]]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        run, term, record = (b.column(i) for i in range(3))
        seen = record.is_valid().to_numpy(zero_copy_only=False)
        cut = _differs(run, term)
        at = np.flatnonzero(cut)
        ends = np.append(at[1:], b.num_rows)
        again, lost = (np.add.reduceat(x.astype(np.int64), at) for x in (~cut & ~_differs(record) & seen, ~seen))
        head = np.minimum(at + lost, ends - 1)  # rows without a record come first

        def state(i: int) -> list:
            lo, hi, some = int(at[i]), int(ends[i]), int(ends[i] - at[i] - lost[i])  # noqa: B023
            first, last = (record[int(head[i])].as_py(), record[hi - 1].as_py()) if some else (None, None)  # noqa: B023
            return [run[lo].as_py(), term[lo].as_py(), hi - lo, int(again[i]), int(lost[i]), first, last]  # noqa: B023

        begins = state(0)
        if open_ is not None and open_[:2] == begins[:2]:
            same = begins[5] is not None and begins[5] == open_[6]
            open_ = [*open_[:2], open_[2] + begins[2], open_[3] + begins[3] + same, open_[4] + begins[4],
                     begins[5] if open_[5] is None else open_[5], open_[6] if begins[6] is None else begins[6]]
        else:
            if open_ is not None:
                yield one(open_)
            open_ = begins
        if len(at) == 1:
            continue
        yield one(open_)
        if len(at) > 2:
            mid = slice(1, len(at) - 1)
            lo, n = pa.array(at[mid]), len(at) - 2
            whole = [run.take(lo), term.take(lo), pa.array(np.full(n, part), pa.int32()), pa.array(ends[mid] - at[mid]), pa.array(again[mid]),
                     pa.array(lost[mid]), record.take(pa.array(head[mid])), record.take(pa.array(ends[mid] - 1))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(whole, schema)], schema=schema)
        open_ = state(len(at) - 1)
    if open_ is not None:
        yield one(open_)


def _counted(suffixes: DataFrame, tie: list[str]) -> DataFrame:
    """(run, term, n, n_records) from suffixes (run, term, record and the tie's columns)."""
    record = suffixes.schema["record"].dataType
    out = T.StructType([
        T.StructField("run", suffixes.schema["run"].dataType), T.StructField("term", suffixes.schema["term"].dataType), T.StructField("part", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("dups", T.LongType()), T.StructField("lost", T.LongType()),
        T.StructField("first", record), T.StructField("last", record),
    ])
    schema = to_arrow_schema(out)
    order = ["term", "run", "record"]
    found = suffixes.repartitionByRange(*order, *tie).select("run", "term", "record").sortWithinPartitions(*order)
    found = found.mapInArrow(lambda it: _intervals(it, schema), out)
    w = Window.partitionBy("run", "term").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    again = F.coalesce((F.last("last", ignorenulls=True).over(w) == F.col("first")).cast("long"), F.lit(0))
    found = found.withColumn("again", again).groupBy("run", "term")
    return found.agg(F.sum("n").alias("n"), (F.sum("n") - F.sum("lost") - F.sum("dups") - F.sum("again")).alias("n_records"))


def term_counts(df: DataFrame, term: str, record: str, tie: str | None = None) -> DataFrame:
    """(term, n, n_records) of every term, one term a row.

    tie: a column that tells a term's rows in one record apart; it lets very many of them be split.
    """
    rows = df.where(F.col(term).isNotNull()).select(
        F.lit(0).cast("byte").alias("run"), F.col(term).alias("term"), F.col(record).alias("record"), *([F.col(tie).alias("tie")] if tie else [])
    )
    return _counted(rows, ["tie"] if tie else []).select("term", "n", "n_records")


def text_of(df: DataFrame, sequence: str, term: str, order: Sequence[str], record: str) -> DataFrame:
    """(place, sequence, record, term): all terms in the order of their sequences, numbered without a gap."""
    rows = df.where(F.col(term).isNotNull()).select(
        F.col(sequence).alias("sequence"), F.col(record).alias("record"), F.col(term).alias("term"), *(F.col(c).alias(f"order{i}") for i, c in enumerate(order))
    )
    by = ["sequence", *(f"order{i}" for i in range(len(order)))]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("sequence", "record", "term", F.monotonically_increasing_id().alias("id"))
    rows = stored(rows)
    part = F.shiftright("id", 33).cast("int")
    sizes = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    small = F.broadcast(df.sparkSession.createDataFrame(starts, "p int, start long"))
    place = F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("p", part).join(small, "p").select(place.alias("place"), "sequence", "record", "term")


def run_counts(df: DataFrame, record: str, term: str, order: Sequence[str], sequence: str | None = None, longest: int | None = None) -> DataFrame:
    """(run, length, n, n_records): every run of terms, as an array, with its occurrences and records; see the module.

    df has a row per term; a sequence's terms follow each other by the columns ``order``. sequence: the column whose
    terms form a text, by default the record. longest: runs longer than that are not looked for.
    """
    text = text_of(df, sequence or record, term, order, record)
    item = F.struct("place", "sequence", "term")
    block = F.floor(F.col("place") / WINDOW).cast("long")
    windows = text.withColumn("w", F.explode(F.array(block, block - 1))).groupBy("w").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.array_sort(F.collect_list(F.struct("place", "record"))).alias("records")
    )  # of 2 * WINDOW terms each
    windows = stored(windows)

    def ahead(place: Column, own: Column, start: Column) -> Column:
        """The terms of the suffix that begins at place from start on."""
        near = F.filter("items", lambda x: (x["place"] >= start) & (x["place"] < start + WINDOW) & ((x["sequence"] == own) | (x["place"] == place)))
        return F.transform(near, lambda x: x["term"]).alias("ahead")

    here = F.explode(F.filter(F.arrays_zip("items", "records"), lambda x: F.floor(x["items"]["place"] / WINDOW) == F.col("w")))
    live = windows.select(here.alias("x"), "items").select(
        F.col("x.items.place").alias("place"), F.col("x.items.sequence").alias("sequence"), F.col("x.records.record").alias("record"), F.lit(0).cast("long").alias("run"),
        ahead(F.col("x.items.place"), F.col("x.items.sequence"), F.col("x.items.place")),
    )
    runs = df.sparkSession.range(1).select(F.col("id").alias("run"), F.array().cast(T.ArrayType(text.schema["term"].dataType)).alias("terms"))
    found, length = None, 0
    while longest is None or length < longest:
        if length and length % WINDOW == 0:
            far = live.drop("ahead").withColumn("w", F.floor((F.col("place") + length) / WINDOW).cast("long"))
            live = far.join(windows.select("w", "items"), "w").select("place", "sequence", "record", "run", ahead(F.col("place"), F.col("sequence"), F.col("place") + length))
        length += 1
        live = stored(live.withColumn("term", F.get("ahead", F.lit((length - 1) % WINDOW))).where(F.col("term").isNotNull()))
        counts = _counted(live.select("run", "term", "record", "place"), ["place"]).join(runs, "run")
        counts = counts.select("run", "term", F.monotonically_increasing_id().alias("next"), F.array_append("terms", F.col("term")).alias("terms"), "n", "n_records")
        counts = stored(counts)
        new = counts.select(F.col("terms").alias("run"), F.lit(length).alias("length"), "n", "n_records")
        found = new if found is None else found.unionByName(new)
        more = counts.where("n > 1").select("run", "term", "next", "terms")
        k = more.count()
        if not k:
            break
        live = live.join(counted(more.select("run", "term", "next"), k), ["run", "term"]).select("place", "sequence", "record", F.col("next").alias("run"), "ahead")
        runs = more.select(F.col("next").alias("run"), "terms")
    return found


def mark(counts: DataFrame, n_records: int, rare: int, common: float) -> Column:
    """rare, common, or null for a term to select by; a term in no record has no mark."""
    return F.when(F.col("n_records") == 0, F.lit(None)).when(F.col("n_records") <= rare, "rare").when(F.col("n_records") >= common * n_records, "common")
