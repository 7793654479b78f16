"""Sources: Parquet tables, inline values, raw SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """An inline relation with stated types; it may have no rows."""
    return spark.createDataFrame(rows, schema)


def raw(spark: SparkSession, text: str, args: dict | list | None = None, **frames: DataFrame) -> DataFrame:
    """SQL text with bound parameters; ``{name}`` stands for a frame."""
    return spark.sql(text, args=args, **frames)


def raw_scalar(spark: SparkSession, text: str, args: dict | list | None = None, **frames: DataFrame):
    row = spark.sql(text, args=args, **frames).first()
    return row[0] if row else None
