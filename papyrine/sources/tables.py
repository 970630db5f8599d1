"""Readers for the driver's Parquet tables. Columns are chosen by the caller, so that scans stay narrow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data folder, reduced to ``columns`` if any are named (they reach the scan's ReadSchema)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
