"""Session helpers shared by every module of the engine."""

from __future__ import annotations

import getpass
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(master: str = "local[8]", app: str = "gridloom", **conf: str) -> SparkSession:
    """A session with the settings the engine's tests and bench use; a running session is reused."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, set here only where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        found = f"file:///tmp/gridloom-{getpass.getuser()}-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have the JVM remove a folder when it ends; it is made now if need be."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)


def written(df: DataFrame, tag: str = "table", **options: str) -> DataFrame:
    """Write df once to the shared folder and return a reader of it: cuts lineage, survives lost executors.

    The files are removed when the JVM that wrote them ends, the shuffle files behind them at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{tag}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, tag: str = "settled", most_rows: int = 20_000) -> DataFrame:
    """A result that is expected to be small, computed once: up to most_rows rows become a local table that joins broadcast,
    more are written to the shared folder and join as Spark sees fit."""
    found = df.limit(most_rows + 1).toArrow()
    if found.num_rows > most_rows:
        return written(df, tag)
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema) if found.num_rows else df.sparkSession.createDataFrame([], df.schema))


def sized(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """df, to be broadcast where its rows are counted to be few enough; df is counted, so a costly plan is better written first."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
