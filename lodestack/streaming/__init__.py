"""Continuous evaluation: counts by condition over prediction facts that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def facts_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Per-image facts as they are written."""
    return spark.readStream.schema(schema).parquet(path)


def running_recall(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Hits and misses by condition; the state has one row for each condition, however long the stream."""
    return facts.groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.count("*").alias("n_images"))
