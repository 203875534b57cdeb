"""The report over both panels: homes of parents and children, and of couples, by size of city."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.recode import recode_labels
from hearthline.operators.plotdata import boxplot_data
from hearthline.operators.shape import union_all
from hearthline.operators.skew import group_quantiles, same_key_join
from hearthline.operators.tables import distribution_table


def joint_homes(families: DataFrame, couples: DataFrame, place: str, tier: str, value: str, homes: str) -> DataFrame:
    """(tier, value, homes) of both panels, each row once; couples live in the one place `place`."""
    return union_all(families.select(tier, value, homes), couples.select(F.lit(place).alias(tier), value, homes))


def home_value_table(homes: DataFrame, tier: str, value: str) -> DataFrame:
    """n, mean, sd and quartiles of the value of homes in each tier, among those with one."""
    return distribution_table(homes.filter(F.col(value) > 0), tier, value)


def home_value_boxes(homes: DataFrame, tier: str, value: str, number: str, limits: tuple[float, float] = (0.0, 180.0)) -> DataFrame:
    """Boxes of the value of homes for each tier and number of homes; values outside the axis are dropped first. Homes of
    unknown number, or in no tier, have a box of their own."""
    both = F.struct(F.col(tier).alias("t"), F.col(number).alias("n"))
    boxes = boxplot_data(homes.filter(F.col(value) > 0).select(both.alias("cell"), value), "cell", value, limits)
    return boxes.select(F.col("cell.t").alias(tier), F.col("cell.n").alias(number), *[c for c in boxes.columns if c != "cell"])


def wealth_by_tier(families: DataFrame, couples: DataFrame, tier: str, tiers: Mapping[str, str], place: str,
                   families_medians: Mapping[str, tuple[str, float]], couples_medians: Mapping[str, tuple[str, float]]) -> DataFrame:
    """(tier, num, type, metric): medians by tier of the families, and of all couples as the line `place`.

    A median is given as {type: (column, scale)}; a type that the couples lack is missing in their line. Labels of `tier` are
    joined as `tiers` says, others stay.
    """
    grouped = families.withColumn(tier, recode_labels(tier, tiers))
    cells = grouped.groupBy(tier).agg(F.count(F.lit(1)).alias("num"))
    for name, (column, scale) in families_medians.items():
        cells = same_key_join(cells, _median(grouped, [tier], column, scale, name), [tier], "left")
    line = couples.agg(F.count(F.lit(1)).alias("num")).select(F.lit(place).alias(tier), "num")
    for name in families_medians:
        column, scale = couples_medians.get(name, (None, 1.0))
        if column is None:
            line = line.withColumn(name, F.lit(None).cast("double"))
        else:
            line = line.join(F.broadcast(_median(couples.withColumn("__all", F.lit(place)), ["__all"], column, scale, name).drop("__all")), F.lit(True), "left")  # one row
    return cells.unionByName(line).unpivot([tier, "num"], list(families_medians), "type", "metric")


def _median(rows: DataFrame, keys: list[str], column: str, scale: float, out: str) -> DataFrame:
    scaled: Column = F.col(out) * F.lit(scale)
    return group_quantiles(rows, keys, column, {out: 0.5}).withColumn(out, scaled)
