"""Session helpers: a local session for tests, and the shared folder for cut lineage.

Nothing here is tied to one machine: the shared folder is the one the cluster names in
``spark.checkpoint.dir``; a local one is set only where that setting is absent, as in tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("papyrine")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PAPYRINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; on one machine set to a new one where
    unset, on a cluster an error."""
    jsc = spark.sparkContext._jsc.sc()
    chosen = jsc.getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="papyrine-checkpoints-")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def shared_base(spark: SparkSession) -> str:
    """The folder as the cluster names it, the same for every application."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return named or shared_dir(spark)


#: A table of at most this many rows is shared with every task.
SHARED_ROWS = 200_000


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows: int = SHARED_ROWS) -> DataFrame:
    """A join with a table that is mostly small: shared with every task if its counted rows are at most ``rows``,
    else left to Spark. ``right`` should be written or cheap, for it is counted first."""
    return left.join(F.broadcast(right) if right.limit(rows + 1).count() <= rows else right, on, how)


def once(df: DataFrame, key: str, rows: int = SHARED_ROWS) -> DataFrame:
    """Distinct rows of a table in which few keys come twice, without a shuffle of all its columns.

    The keys that come twice are found from the key column alone; only their rows are compared whole. Beyond ``rows``
    such keys all rows are compared. Rows of a null key are left out."""
    twice = cut(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key))
    if twice.limit(rows + 1).count() > rows:
        return df.filter(F.col(key).isNotNull()).distinct()
    shared = F.broadcast(twice)
    return df.filter(F.col(key).isNotNull()).join(shared, key, "left_anti").unionByName(df.join(shared, key, "left_semi").distinct())


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there: later actions do not recompute it,
    and the loss of an executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
