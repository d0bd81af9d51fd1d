"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for a Spark context; it goes by the checkpoint folder."""
    sc = spark.sparkContext
    if getattr(sc, "_latticework_sent", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/latticework.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    sc._latticework_sent = True


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", app: str = "latticework") -> SparkSession:
    """A session for one machine: tests, bench, trying things out."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own setting, or a temporary one where Spark runs in one process.

    Checkpoints that nothing reads any more are deleted by Spark, also where the session wasn't set up for that.
    """
    sc = spark.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="latticework-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from the files; what reads it survives the loss of executors.

    Rows stay partitioned as they are, so a table partitioned once meets others in a loop without moving again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders written by ``stored``, each with a weak reference to the JVM object that every plan reading it holds.
_tables: list[tuple] = []


def _sweep(spark: SparkSession) -> None:
    """Delete the written tables that no plan can read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    app = spark.sparkContext.applicationId
    for entry in [t for t in _tables if t[2] != app or t[1].get() is None]:
        _tables.remove(entry)
        if entry[2] == app:
            path = jvm.org.apache.hadoop.fs.Path(entry[0])
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside are deleted when it was, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table beside the checkpoints and go on from it: for large tables that are read more
    than once, compressed and by the columns that are needed. It is deleted some time after its last reader is gone."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    _sweep(spark)
    with _shuffles_dropped(spark):
        df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    location = out._jdf.queryExecution().analyzed().relation().location()
    _tables.append((folder, spark._jvm.java.lang.ref.WeakReference(location), spark.sparkContext.applicationId))
    return out


#: Rows of a table that may be broadcast once they were counted; beyond it Spark shuffles.
BROADCAST_ROWS = 100_000


def counted(df: DataFrame, n: int) -> DataFrame:
    """df, which has n rows, to be broadcast if these are few."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df
