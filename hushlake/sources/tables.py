"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table; Parquet carries the schema, so nothing is inferred from data."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
