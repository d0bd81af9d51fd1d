"""Edge lines that keep arriving, read as the batch reader reads them; lines that are no edge are put aside, not lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from latticework.sources.text import edge_lines


def line_stream(spark: SparkSession, folder: str, weighted: bool = True) -> DataFrame:
    """A stream of (value, src, dst, weight, reason) from the text files that appear in a folder."""
    return edge_lines(spark.readStream.text(folder), weighted)


def edge_stream(spark: SparkSession, folder: str, weighted: bool = True) -> DataFrame:
    """A stream of (src, dst, weight), each line once; see ``reject_stream`` for the others."""
    return line_stream(spark, folder, weighted).where("reason IS NULL").select("src", "dst", "weight")


def reject_stream(spark: SparkSession, folder: str, weighted: bool = True) -> DataFrame:
    """A stream of (value, reason): the lines that are no edge."""
    return line_stream(spark, folder, weighted).where("reason IS NOT NULL").select("value", "reason")


def _append(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    out = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start(folder)


def store_stream(edges: DataFrame, folder: str, checkpoint: str, undirected: bool = True) -> StreamingQuery:
    """Append a stream of lines to a graph store's edge table, each exactly once; ends when all there is is read.

    undirected: whether the stored graph counts each line in both directions, as in Graph.
    """
    return _append(edges.withColumn("undirected", F.lit(undirected)), f"{folder}/edges", checkpoint)


def ingest(spark: SparkSession, source: str, folder: str, checkpoint: str, undirected: bool = True, weighted: bool = True) -> list[StreamingQuery]:
    """Append the edges among source's lines to a store, and the other lines to its table ``rejects``."""
    return [
        store_stream(edge_stream(spark, source, weighted), folder, f"{checkpoint}/edges", undirected),
        _append(reject_stream(spark, source, weighted), f"{folder}/rejects", f"{checkpoint}/rejects"),
    ]


def degree_stream(edges: DataFrame, undirected: bool = True) -> DataFrame:
    """(id, degree) so far; for the update or complete mode."""
    ends = F.array("src", "dst") if undirected else F.array("src")
    return edges.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
