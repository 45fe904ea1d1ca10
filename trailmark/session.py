"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the plans rely on; AQE splits skewed join partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[8]", **extra: str) -> SparkSession:
    """A local session with the defaults; on a cluster, pass the cluster's own session instead."""
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"} | extra
    builder = SparkSession.builder.master(master).appName("trailmark")
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without the setting gets one of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="trailmark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    system, place = file_system(spark, path)
    system.deleteOnExit(place)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage (an iteration doesn't replay its past, a lost executor costs only its
    running tasks) and fixes results that a recomputation could order differently. The table goes when the
    driver's JVM ends, or before by :func:`release`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        system, place = file_system(df.sparkSession, df.scratch)
        system.delete(place, True)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path or URI, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer splits than half of them; a table of many splits stays as it is.

    For scans that feed work by the row in Python or in regular expressions: a file of one row group is one split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
