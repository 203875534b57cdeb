"""Tables kept in the shared folder between the steps of an operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.session import shared_folder


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (`spark.checkpoint.dir`)."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: later steps neither repeat the work nor
    depend on an executor that may be lost. `small` tables, such as one row for each source, go to fewer files than a shuffle has partitions."""
    path = folder(df.sparkSession, name)
    if small:
        df = df.repartition(1 + int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 32)
    # many small files at once: the default codec would hold direct memory for each
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def col(name: str):
    """A column by its exact name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")
