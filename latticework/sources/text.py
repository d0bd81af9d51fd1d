"""Reading and writing graphs as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.bits import out_of_range


def _fields(df: DataFrame) -> DataFrame:
    return df.select("value", F.split(F.trim(F.regexp_replace("value", r"[\s,]+", " ")), " ").alias("f")).where(F.col("f")[0] != "")


def _id(i: int) -> Column:
    return F.col("f")[i].cast("long")


def _checked(df: DataFrame, *ids: str) -> DataFrame:
    """df, failing when it is run if an id is negative (or, by the cast, above 2^63-1 or no number)."""
    bad = out_of_range(*(F.col(i) for i in ids))
    first = F.when(bad, F.raise_error(F.concat(F.lit("id out of range: "), F.concat_ws(" ", *ids))).cast("long")).otherwise(F.col(ids[0]))
    return df.withColumn(ids[0], first)


def edge_lines(lines: DataFrame, weighted: bool) -> DataFrame:
    """(value, src, dst, weight, reason) of lines ``src dst [weight]``, fields apart by white space or commas; empty
    lines are none. reason is null for a line that is an edge. weight: 0 where a line of a weighted list has none.

    Batch and streaming readers share this; the first fails on a line with a reason, the second puts it aside.
    """
    get = lambda i, to: F.get("f", F.lit(i)).try_cast(to)
    e = _fields(lines).select("value", "f", get(0, "long").alias("src"), get(1, "long").alias("dst"), get(2, "double").alias("weight"))
    reason = (
        F.when(F.size("f") < 2, "columns").when(F.col("src").isNull() | F.col("dst").isNull() | (F.col("src") < 0) | (F.col("dst") < 0), "id")
        .when((F.size("f") > 2) & F.col("weight").isNull() & F.lit(weighted), "weight")
    )
    weight = F.coalesce("weight", F.lit(0.0)) if weighted else F.lit(None).cast("double")
    return e.select("value", "src", "dst", weight.alias("weight"), reason.alias("reason"))


def read_edges(spark: SparkSession, paths: str | Sequence[str], undirected: bool = False) -> DataFrame:
    """(src, dst, weight) from lines ``src dst [weight]``; weight is 0 where a line of a weighted list has none.

    Whether the list is weighted is told by the first line, as everything else is cheaper to say than to search.
    """
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    first = _fields(lines).first()
    e = edge_lines(lines, first is not None and len(first.f) > 2)
    wrong = F.raise_error(F.concat(F.lit("no edge, for its "), "reason", F.lit(": "), "value")).cast("long")
    edges = e.select(F.when(F.col("reason").isNotNull(), wrong).otherwise(F.col("src")).alias("src"), "dst", "weight")
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")) if undirected else edges


def read_factor(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(vertices, edges) of a Kronecker factor: a line with the number of vertices, then ``src dst weight``, made symmetric.

    Any other line fails; the number must stand in the first line and nowhere else.
    """
    text = spark.read.text(path)
    head = _fields(text).first()
    if head is None or len(head.f) != 1 or not head.f[0].isdigit():
        raise ValueError(f"{path} must begin with the number of vertices")
    n = int(head.f[0])
    single = [r.f for r in _fields(text).where(F.size("f") == 1).limit(2).collect()]
    if len(single) != 1:
        raise ValueError(f"not an edge: {single[1][0]}")
    lines = _fields(text).where(F.size("f") > 1)
    bad = F.when((F.size("f") != 3), F.raise_error(F.concat(F.lit("not an edge: "), F.concat_ws(" ", "f"))).cast("long")).otherwise(_id(0))
    e = lines.select(bad.alias("src"), _id(1).alias("dst"), F.col("f")[2].cast("long").alias("weight"))
    return n, e.unionByName(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def read_labels(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(id, label) from lines ``id label``, from files, folders or globs; the smallest of several labels stays."""
    lines = _fields(spark.read.text(list(paths) if not isinstance(paths, str) else paths))
    return _checked(lines.select(_id(0).alias("id"), _id(1).alias("label")), "id").groupBy("id").agg(F.min("label").alias("label"))


def read_label_list(spark: SparkSession, list_file: str) -> DataFrame:
    """Labels from the files that list_file names, one a line; a name that isn't there is looked up beside the list.

    The list and the files may be on any file system that Spark reads.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path

    def there(name: str) -> bool:
        at = path(name)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    here = path(list_file).getParent().toString()
    names = [r.value.strip() for r in spark.read.text(list_file).collect() if r.value.strip()]
    return read_labels(spark, [x if there(x) else f"{here}/{x.rsplit('/', 1)[-1]}" for x in names])


def read_hdf5(spark: SparkSession, paths: Sequence[str], source: str, target: str, weight: str | None = None) -> DataFrame:
    """(src, dst, weight) from one-dimensional HDF5 datasets; one task reads each file. Needs h5py."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("h5py is not installed; convert the file to Parquet") from e

    def read(batches):
        import h5py
        import pandas as pd

        for b in batches:
            for path in b.path:
                with h5py.File(path) as f:
                    for lo in range(0, len(f[source]), 1 << 20):
                        cut = slice(lo, lo + (1 << 20))
                        yield pd.DataFrame({"src": f[source][cut], "dst": f[target][cut], "weight": f[weight][cut].astype(float) if weight else None})

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return files.mapInPandas(read, "src long, dst long, weight double")


def write_lines(df: DataFrame, folder: str, *columns: str, mode: str = "error") -> None:
    """df's columns as lines of text with one space between them."""
    df.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns or df.columns)).alias("value")).write.mode(mode).text(folder)


def write_matches(matches: DataFrame, folder: str, mode: str = "error") -> None:
    """One line per match: the data vertices of query vertices 0, 1, ..."""
    write_lines(matches, folder, *(f"m{i}" for i in range(len(matches.columns))), mode=mode)


def write_walks(matches: DataFrame, walk: Sequence[int], folder: str, mode: str = "error") -> None:
    """One line per match: the data vertices along a walk over the query, revisits included."""
    matches.select(F.concat_ws(", ", *(F.col(f"m{u}").cast("string") for u in walk)).alias("value")).write.mode(mode).text(folder)


def pruned_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): ``v id label bits`` and ``e src dst`` lines of a pruned graph."""
    v = vertices.select(F.concat_ws(" ", F.lit("v"), "id", "label", F.bin(F.col("bits")).cast("string")).alias("value"))
    return v.unionByName(edges.select(F.concat_ws(" ", F.lit("e"), "src", "dst").alias("value")))


def read_pruned(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices(id, label, bits), edges(src, dst)) from the lines of a pruned graph."""
    f = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    v = f.where(F.col("f")[0] == "v").select(_id(1).alias("id"), _id(2).alias("label"), F.conv(F.get("f", F.lit(3)), 2, 10).cast("long").alias("bits"))
    return v, f.where(F.col("f")[0] == "e").select(_id(1).alias("src"), _id(2).alias("dst"))
