"""Roll-ups per household and picking one row per group.

Picks are aggregates (min/max of an ordered struct), not sorted windows: they combine map-side, so
a group of any size is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hearthline.functions.recode import cut
from hearthline.operators.skew import group_quantiles, lookup_join, next_in_group, running_total

# --- aggregates -----------------------------------------------------------------------------


def group_sum(df: DataFrame, keys: list[str], cols: Sequence[str], na_zero: bool = True) -> DataFrame:
    """Sums that skip missing values; a group of only missing values gives 0 (or missing)."""
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)) if na_zero else F.sum(n)
    return df.groupBy(*keys).agg(*[total(n).alias(n) for n in cols])


def group_mean_n(df: DataFrame, keys: list[str], x: str, drop_missing: bool = True) -> DataFrame:
    """n and mean per cell; cells with a missing key or mean are dropped."""
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"))
    return cells.na.drop("any") if drop_missing else cells


def strict_mean(x: str) -> Column:
    """Mean that is missing as soon as one value is."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def group_mean_strict(df: DataFrame, keys: list[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[strict_mean(n).alias(n) for n in cols])


def group_median(df: DataFrame, keys: list[str], x: str, scale: float = 1.0, out: str = "median") -> DataFrame:
    return group_quantiles(df, keys, x, {out: 0.5}).withColumn(out, F.col(out) * F.lit(scale))


def group_profile(df: DataFrame, keys: list[str], metrics: Mapping[str, Column], digits: int = 2,
                  min_n: int | None = None) -> DataFrame:
    """Several rounded metrics per group, with the group's share of all rows."""
    cells = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.round(m, digits).alias(n) for n, m in metrics.items()]
    )
    total = df.agg(F.count(F.lit(1)))
    cells = cells.withColumn("share", F.round(F.col("n") / total.scalar(), digits))
    return cells if min_n is None else cells.filter(F.col("n") > min_n)


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def distinct_keys(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def mean_by_missing(df: DataFrame, x: str, others: Sequence[str]) -> DataFrame:
    """Means of other columns by whether `x` is missing."""
    return df.groupBy(F.col(x).isNull().alias("missing")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(o).alias(f"mean_{o}") for o in others]
    )


def row_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def quantile_breaks(df: DataFrame, x: str, probs: Sequence[float]) -> DataFrame:
    """One row, one column per cut point (b0, b1, ...)."""
    return group_quantiles(df, [], x, {f"b{i}": p for i, p in enumerate(probs)})


def quantile_bin(df: DataFrame, x: str, probs: Sequence[float], labels: Sequence[str],
                 include_lowest: bool = True, out: str = "bin") -> DataFrame:
    """Label by quantile interval, right-closed; the minimum is missing unless `include_lowest`.

    The breaks are read once as a handful of numbers and enter the plan as literals.
    """
    breaks = quantile_breaks(df, x, probs).first()
    values = [breaks[f"b{i}"] for i in range(len(probs))]
    if any(b is None for b in values):
        return df.withColumn(out, F.lit(None).cast("string"))
    return df.withColumn(out, cut(x, values, labels, include_lowest))


# --- one row per group ----------------------------------------------------------------------


def pick_first(df: DataFrame, keys: list[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group along ascending `order` (end it with a unique column).

    Missing order values come first; see `last` to put them at the end.
    """
    values = [n for n in df.columns if n not in keys]
    sort_key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = F.min_by(F.struct(*values), sort_key).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{n}").alias(n) for n in values])


def last(x: str) -> list[Column]:
    """Ascending order with missing values at the end."""
    return [F.col(x).isNull(), F.col(x)]


def desc(x: str) -> list[Column]:
    """Descending order of a number with missing values at the end."""
    return [F.col(x).isNull(), -F.col(x)]


def householder(df: DataFrame, keys: list[str], role: str, order: Sequence[str], tie: str) -> DataFrame:
    """First person of the most preferred role, e.g. father before mother; persons of other or missing roles come last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in order]), F.col(role)), F.lit(0)), F.lit(len(order) + 1))
    return pick_first(df, keys, [place, F.col(tie)])


def sample_one(df: DataFrame, keys: list[str], ids: Sequence[str], seed: int) -> DataFrame:
    """One row per group by a seeded hash of its id: the same row however the data is split."""
    drawn = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(i).cast("string"), F.lit("")) for i in ids]))
    return pick_first(df, keys, [drawn, *[F.col(i) for i in ids]])


def pick_longest_spell(df: DataFrame, keys: list[str], start: str, end: str, slot: str) -> DataFrame:
    """Spell of the longest duration, lowest slot on ties; a spell without an end never wins against
    slot 1, the starting choice. Slot 0 is not considered."""
    years = F.coalesce(F.col(end), F.lit(0)) - F.coalesce(F.col(start), F.lit(0))
    eligible = (F.coalesce(F.col(end), F.lit(0)) != 0) | (F.col(slot) == 1)
    return pick_first(
        df.filter((F.col(slot) >= 1) & eligible).withColumn("duration", years), keys, [-F.col("duration"), F.col(slot)]
    )


def pick_best_overlap(df: DataFrame, keys: list[str], overlap: str, end: str, tie: str) -> DataFrame:
    """Spell with the most years in the window; with none in it, the one that ended first."""
    fallback = F.when(F.col(overlap) > 0, F.lit(0)).otherwise(F.col(end))
    return pick_first(df, keys, [-F.col(overlap), fallback.isNull(), fallback, F.col(tie)])


def top1(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First row of the whole table along `order`; each task keeps one row."""
    return df.orderBy(*order).limit(1)


def top_value(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(x).alias(out))


def nearest_before(df: DataFrame, keys: list[str], gap: Column, slot: str, default: str = "1") -> DataFrame:
    """Long form: slot with the smallest positive gap if only one row has it, else `default`.

    Rows are first counted per (group, gap), then the smallest gap is taken: both combine map-side.
    """
    known = df.select(*keys, F.when(gap > 0, gap).alias("__gap"), F.col(slot).cast("string").alias("__slot"))
    per_gap = known.groupBy(*keys, "__gap").agg(F.count(F.lit(1)).alias("__n"), F.min("__slot").alias("__slot"))
    best = per_gap.groupBy(*keys).agg(
        F.min(F.when(F.col("__gap").isNotNull(), F.struct("__gap", "__n", "__slot"))).alias("__best")
    )
    return best.select(*keys, F.coalesce(F.when(F.col("__best.__n") == 1, F.col("__best.__slot")), F.lit(default)).alias(slot))


# --- columns that look at the whole group ---------------------------------------------------


# `hot` is the result of `skew.hot_groups` where a caller knows it already; it saves a count of the keys.


def group_size_col(df: DataFrame, keys: list[str], out: str = "n", hot: list[Row] | None = None) -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return lookup_join(df, sizes, keys, "left", missing_keys_match=True, hot=hot)


def last_activity_year(df: DataFrame, keys: list[str], end: str, out: str = "last_year", hot: list[Row] | None = None) -> DataFrame:
    """Latest spell end per person, on every spell."""
    latest = df.groupBy(*keys).agg(F.max(end).alias(out))
    return lookup_join(df, latest, keys, "left", missing_keys_match=True, hot=hot)


def sibling_rank(df: DataFrame, keys: list[str], order: Sequence[Column], out: str = "sibling_rank",
                 hot: list[Row] | None = None) -> DataFrame:
    """Place in the household along `order` (end it with a unique column)."""
    return running_total(df, keys, list(order), out, hot=hot)


def spell_to_next(df: DataFrame, keys: list[str], order: Sequence[Column], start: str, end: str = "end",
                  hot: list[Row] | None = None) -> DataFrame:
    """A state lasts until the next change of the same person."""
    return next_in_group(df, keys, list(order), {end: start}, hot=hot)


def arrange(df: DataFrame, *cols: tuple[str, str]) -> DataFrame:
    """Sort with missing values last in both directions: ("x", "asc"), ("y", "desc")."""
    by = [F.col(n).desc_nulls_last() if d == "desc" else F.col(n).asc_nulls_last() for n, d in cols]
    return df.orderBy(*by)
