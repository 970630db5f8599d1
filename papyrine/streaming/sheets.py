"""Incremental ingestion of sheets: a file stream with an available-now trigger, latest states kept by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrine.session import shared_base
from papyrine.sources.files import rewrite_keyed


def ingest(spark: SparkSession, source: str, schema: str, table: str, keys: list[str], order: str, name: str) -> StreamingQuery:
    """Takes in the Parquet files of ``source`` that are new since the last run, keeps the latest row of each key in
    ``table`` (a ``KeyedTable``; only the parts that a batch touches are written), and ends. Progress is kept in the shared folder, so a run that is broken off goes on where it was."""
    stream = spark.readStream.schema(schema).parquet(source)

    def merge(batch: DataFrame, _: int) -> None:
        rewrite_keyed(batch.sparkSession, table, batch, keys, order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{shared_base(spark)}/stream-{name}").trigger(availableNow=True).start()


def arrivals(stream: DataFrame, at: str, delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """(window, model, readings) of a stream of readings: counts by hour and model, late ones within the delay included."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window), "model").agg(F.count("*").alias("readings"))
