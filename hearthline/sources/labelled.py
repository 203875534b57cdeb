"""Reading survey extracts: value labels, legacy encodings, code lists.

Extracts are landed as parquet or CSV with raw codes, next to a label table (col, code, label).
Labels are decoded by joins that Spark runs as broadcasts while the label table is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.functions.text import strip_punct_space
from hearthline.operators.skew import running_total


def read_extract(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet",
                 encoding: str = "UTF-8") -> DataFrame:
    """Landed extract; CSV always needs a schema, it is never inferred by reading the data twice."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV extract needs a schema")
        return spark.read.schema(schema).option("header", True).option("encoding", encoding).csv(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(fmt).load(path)


def decode_labels(df: DataFrame, labels: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace codes by their labels; a code without a label stays as text, of several labels the last in the alphabet holds."""
    for name in cols:
        mine = labels.filter(F.col("col") == name).groupBy(F.col("code").cast("string").alias("__code")).agg(F.max("label").alias("__label"))
        code = F.col(name).cast("string")
        df = (
            df.join(mine, code == F.col("__code"), "left")
            .withColumn(name, F.coalesce("__label", code))
            .drop("__code", "__label")
        )
    return df


def read_labelled(spark: SparkSession, path: str, labels: DataFrame, cols: Sequence[str],
                  schema: T.StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """Extract with value labels put in."""
    return decode_labels(read_extract(spark, path, schema, fmt), labels, cols)


def read_raw_codes(spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "GB2312") -> DataFrame:
    """CSV extract with labels off and legacy text (needs spark.sql.legacy.javaCharsets=true)."""
    return read_extract(spark, path, schema, "csv", encoding)


def read_spss_extract(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Extract whose every column is text: without punctuation and blanks where it was text before, empty is missing;
    numbers keep their sign and point."""
    df = strip_punct_space(read_extract(spark, path, None, fmt))
    return df.select(*[F.col(n).cast("string").alias(n) for n in df.columns])


def read_code_list(spark: SparkSession, path: str) -> DataFrame:
    """Label lists used as sets: a CSV of (list, value)."""
    return spark.read.schema("list string, value string").option("header", True).csv(path)


def code_list_values(code_list: DataFrame, name: str) -> DataFrame:
    return code_list.filter(F.col("list") == name).select("value").distinct()


def levels_of(df: DataFrame, col: str) -> DataFrame:
    """Dictionary of a label column in alphabetical order: (label, ordinal)."""
    labels = df.select(F.col(col).alias("label")).filter(F.col("label").isNotNull()).distinct()
    return running_total(labels, [], [F.col("label").asc()], "ordinal")
