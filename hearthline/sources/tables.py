"""Tables between steps and report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def checkpoint_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write an intermediate table and go on from what was written."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return load_table(df.sparkSession, path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file. For finished tables of a page or so, not for data."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_model_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Coefficient table to CSV or parquet."""
    writer = df.repartition(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
