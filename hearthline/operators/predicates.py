"""Row filters."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hearthline.operators.skew import lookup_join


def filter_all(df: DataFrame, conditions: Iterable[Column]) -> DataFrame:
    """Rows for which every condition is true; a missing condition drops the row."""
    return df.filter(reduce(lambda a, b: a & b, conditions))


def member_filter(df: DataFrame, other: DataFrame, keys: list[str], hot: list[Row] | None = None) -> DataFrame:
    """Rows whose key occurs in another table."""
    return lookup_join(df, other.select(*keys), keys, "left_semi", hot=hot)


def group_size_filter(df: DataFrame, keys: list[str], min_n: int, hot: list[Row] | None = None) -> DataFrame:
    """Rows of groups with more than `min_n` rows."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > min_n).select(*keys)
    return lookup_join(df, big, keys, "left_semi", missing_keys_match=True, hot=hot)


def subpopulation(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)
