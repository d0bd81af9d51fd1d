"""A graph as two DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.bits import degree_label


class Graph:
    """vertices(id, label) and edges(src, dst, weight).

    edges holds what was read, with repeated edges and loops; if the graph is undirected (the default), every edge
    counts in both directions. Rows with a null end are no edges. Vertices are those given, else all ends with
    label 0. A vertex given more than once keeps its smallest label. once: it is known that every edge is there once,
    with src < dst; then none is moved to find repetitions.
    """

    def __init__(self, edges: DataFrame, vertices: DataFrame | None = None, undirected: bool = True, once: bool = False):
        names = edges.columns
        weight = F.col("weight").cast("double") if "weight" in names else F.lit(None).cast("double")
        self.lines = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(
            F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight")
        )
        self.undirected = undirected
        self.once = once
        self._vertices = vertices

    @cached_property
    def vertices(self) -> DataFrame:
        if self._vertices is None:
            ends = self.lines.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
            return ends.withColumn("label", F.lit(0).cast("long"))
        v = self._vertices.where(F.col("id").isNotNull())
        label = F.col("label").cast("long") if "label" in v.columns else F.lit(0).cast("long")
        return v.select(F.col("id").cast("long").alias("id"), label.alias("label")).groupBy("id").agg(F.min("label").alias("label"))

    @cached_property
    def edges(self) -> DataFrame:
        """Every edge in its stored direction, and in the other one if the graph is undirected; loops twice too."""
        if not self.undirected:
            return self.lines
        ends = F.array(F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        return self.lines.select(F.explode(ends).alias("e"), "weight").select("e.src", "e.dst", "weight")

    @cached_property
    def simple(self) -> DataFrame:
        """(src, dst) without loops and repetitions; in both directions if the graph is undirected."""
        return self.edges.select("src", "dst") if self.once else self.edges.where("src <> dst").select("src", "dst").distinct()

    @cached_property
    def pairs(self) -> DataFrame:
        """(a, b) with a < b: the distinct unordered pairs of neighbours."""
        if self.once:
            return self.lines.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        low, high = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
        return self.lines.where("src <> dst").select(low, high).distinct()

    def degrees(self, loops: bool = True) -> DataFrame:
        """(id, degree): edges that leave a vertex, repeated ones counted each."""
        e = self.edges if loops else self.edges.where("src <> dst")
        return e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))

    def degrees_in_out(self) -> DataFrame:
        """(id, n_out, n_in) over the stored directions, for every vertex with an edge."""
        one = F.lit(1).cast("long")
        ends = F.explode(F.array(F.struct(F.col("src").alias("id"), one.alias("o"), (one - 1).alias("i")), F.struct(F.col("dst").alias("id"), (one - 1).alias("o"), one.alias("i"))))
        return self.lines.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))

    def degree_histogram(self) -> DataFrame:
        """(degree, n)"""
        return self.degrees().groupBy("degree").agg(F.count(F.lit(1)).alias("n"))

    def label_histogram(self) -> DataFrame:
        """(label, n)"""
        return self.vertices.groupBy("label").agg(F.count(F.lit(1)).alias("n"))

    def vertex_table(self, hub_degree: int = 1_048_576) -> DataFrame:
        """(id, degree, label, hub): every vertex with its degree (0 without an edge), its label, and whether it is a hub."""
        deg = self.vertices.join(self.degrees(), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), "label")
        return deg.withColumn("hub", F.col("degree") >= hub_degree)

    def with_degree_labels(self) -> Graph:
        """The same edges, each vertex with an edge labelled by ceil(log2(degree + 1))."""
        return Graph(self.lines, self.degrees().select("id", degree_label(F.col("degree")).alias("label")), self.undirected)

    def with_labels(self, labels: DataFrame, default: int = 0) -> Graph:
        """Labels (id, label) put over the ones there are; vertices not among them keep theirs, new ones are added."""
        new = labels.where("id IS NOT NULL").groupBy("id").agg(F.min("label").alias("new"))
        v = self.vertices.join(new, "id", "full").select("id", F.coalesce("new", "label", F.lit(default)).alias("label"))
        return Graph(self.lines, v, self.undirected)

    def induced(self, ids: DataFrame) -> DataFrame:
        """The edges with both ends in ids(id)."""
        some = ids.select("id").distinct()
        out = self.edges.join(some.withColumnRenamed("id", "src"), "src", "left_semi")
        return out.join(some.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")

    def statistics(self, hub_degree: int = 1_048_576) -> DataFrame:
        """One row: vertices, lines, edges, pairs, loops, repeated, largest id and degree, hubs and their edges."""
        deg = self.degrees().agg(
            F.max("degree").alias("max_degree"), F.count(F.when(F.col("degree") >= hub_degree, 1)).alias("hubs"),
            F.coalesce(F.sum(F.when(F.col("degree") >= hub_degree, F.col("degree"))), F.lit(0)).alias("hub_edges"),
        ).first()
        lines = self.lines.agg(F.count(F.lit(1)), F.count(F.when(F.col("src") == F.col("dst"), 1))).first()
        ids = self.vertices.agg(F.count(F.lit(1)), F.max("id")).first()
        row = (ids[0], ids[1], lines[0], lines[0] * (2 if self.undirected else 1), self.pairs.count(), lines[1], deg[0] or 0, deg[1] or 0, deg[2] or 0)
        names = ("vertices", "max_id", "lines", "edges", "pairs", "loops", "max_degree", "hubs", "hub_edges")
        return self.lines.sparkSession.createDataFrame([tuple(map(lambda x: x if x is None else int(x), row))], ", ".join(f"{n} long" for n in names))

    def balance(self) -> DataFrame:
        """(part, edges) over the partitions that Spark gives the edges."""
        return self.edges.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("edges"))

    # The store: a folder with two Parquet tables, read at any parallelism; one filled by a stream may have no vertices.

    def save(self, folder: str, mode: str = "error") -> None:
        self.vertices.write.mode(mode).parquet(f"{folder}/vertices")
        self.lines.withColumn("undirected", F.lit(self.undirected)).write.mode(mode).parquet(f"{folder}/edges")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Graph:
        e = spark.read.parquet(f"{folder}/edges")
        first = e.select("undirected").first()
        vertices = spark.read.parquet(f"{folder}/vertices") if Graph.exists(spark, f"{folder}/vertices") else None
        return Graph(e.drop("undirected"), vertices, first is None or first[0])

    @staticmethod
    def _files(spark: SparkSession, folder: str):
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    @staticmethod
    def exists(spark: SparkSession, folder: str) -> bool:
        fs, path = Graph._files(spark, folder)
        return fs.exists(path)

    @staticmethod
    def copy(spark: SparkSession, source: str, target: str) -> None:
        """A copy of a stored graph: a backup, a transfer to another file system, or a snapshot."""
        if Graph.exists(spark, target):
            raise FileExistsError(target)
        (a, pa), (b, pb) = Graph._files(spark, source), Graph._files(spark, target)
        if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, pa, b, pb, False, spark._jsc.hadoopConfiguration()):
            raise OSError(f"can't copy {source} to {target}")

    @staticmethod
    def remove(spark: SparkSession, folder: str) -> bool:
        fs, path = Graph._files(spark, folder)
        return fs.delete(path, True)

    @staticmethod
    def partitions(spark: SparkSession, folder: str) -> int:
        return spark.read.parquet(f"{folder}/edges").rdd.getNumPartitions()
