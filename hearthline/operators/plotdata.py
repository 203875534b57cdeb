"""The aggregated tables behind the plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.operators.household import group_mean_n, group_mean_strict
from hearthline.operators.skew import group_quantiles, hot_groups, lookup_join


def line_points_data(df: DataFrame, category: str, group: str, x: str) -> DataFrame:
    """Mean and n per category and group; cells with a missing part are dropped."""
    return group_mean_n(df, [category, group], x)


def scatter_lm_data(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Fitted line per group."""
    return df.groupBy(group).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.min(F.when(F.col(y).isNotNull(), F.col(x))).alias("x_min"), F.max(F.when(F.col(y).isNotNull(), F.col(x))).alias("x_max"))


def scatter_points(df: DataFrame, ids: Sequence[str], share: float, seed: int) -> DataFrame:
    """A repeatable share of the rows to draw as points."""
    drawn = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(i).cast("string"), F.lit("")) for i in ids]))
    return df.filter(drawn < F.lit(f"{int(share * 2**32):08x}"))


def boxplot_data(df: DataFrame, group: str, x: str, limits: tuple[float, float] | None = None) -> DataFrame:
    """Quartiles, whisker ends (furthest value within 1.5 box lengths) and number of outliers.

    Axis limits drop rows before anything is computed.
    """
    rows = df.select(group, F.col(x).cast("double").alias("x")).filter(F.col("x").isNotNull())
    if limits:
        rows = rows.filter(F.col("x").between(*limits))
    hot = hot_groups(rows, [group])
    boxes = group_quantiles(rows, [group], "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, hot)
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col("x").between(F.col("q25") - reach, F.col("q75") + reach)
    # every group has one box row: grouping by it as well keeps the quartiles without a second join
    joined = lookup_join(rows, boxes, [group], "inner", missing_keys_match=True, hot=hot)
    return joined.groupBy(group, "q25", "q50", "q75").agg(
        F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high"),
        F.sum((~inside).cast("long")).alias("n_outliers"))


def stacked_bar_data(df: DataFrame, group: str, parts: Sequence[str]) -> DataFrame:
    """Mean of each stack part per group, missing if any value is."""
    means = group_mean_strict(df, [group], parts)
    return means.unpivot([group], list(parts), "part", "mean")


def histogram_data(df: DataFrame, x: str, binwidth: float = 5) -> DataFrame:
    """Counts per bin; bins are centred on multiples of the width."""
    place = F.floor((F.col(x) + F.lit(binwidth / 2)) / F.lit(binwidth))
    return df.filter(F.col(x).isNotNull()).groupBy((place * F.lit(binwidth)).cast("double").alias("center")).agg(F.count(F.lit(1)).alias("n"))


def bar_data(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy(F.col(x).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def variable_plot_data(df: DataFrame, x: str, binwidth: float = 5) -> DataFrame:
    """Histogram of a number, bars of a label."""
    return histogram_data(df, x, binwidth) if isinstance(df.schema[x].dataType, T.NumericType) else bar_data(df, x)
