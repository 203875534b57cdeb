"""Joins between persons, households, children and communities.

Nothing is broadcast by hand: Spark broadcasts a side whose size it knows to be small and changes
its mind at run time; joins on a key that can be hot go through `skew.lookup_join`. `hot=[]` says
that the rows cannot have a hot key, e.g. because they have one row per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from hearthline.functions.household import overlap_years
from hearthline.operators.shape import suffix_cols
from hearthline.operators.skew import lookup_join


def left_join(left: DataFrame, right: DataFrame, keys: list[str], missing_keys_match: bool = False,
              hot: list[Row] | None = None) -> DataFrame:
    """`missing_keys_match`: a missing key finds a missing key, as in the R verbs."""
    return lookup_join(left, right, keys, "left", missing_keys_match, hot)


def person_attr_join(base: DataFrame, attributes: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """Stack one-row-per-person tables onto the base table."""
    return reduce(lambda a, b: a.join(b, keys, "left"), attributes, base)


def full_join(tables: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """Households of any of the tables (one row per key in each); key columns are merged."""
    return reduce(lambda a, b: a.join(b, keys, "outer"), tables)


def inner_join(left: DataFrame, right: DataFrame, keys: list[str], hot: list[Row] | None = None) -> DataFrame:
    return lookup_join(left, right, keys, "inner", hot=hot)


def right_join(left: DataFrame, right: DataFrame, keys: list[str], hot: list[Row] | None = None) -> DataFrame:
    """Keep every row of the current wave (`right`), bring in the earlier one (`left`)."""
    joined = lookup_join(right, left, keys, "left", hot=hot)
    return joined.select(*keys, *[n for n in left.columns if n not in keys],
                         *[n for n in right.columns if n not in keys])


def natural_left_join(left: DataFrame, right: DataFrame, hot: list[Row] | None = None) -> DataFrame:
    return lookup_join(left, right, [n for n in left.columns if n in right.columns], "left", hot=hot)


def dim_join(df: DataFrame, dim: DataFrame, keys: list[str], defaults: Mapping[str, object]) -> DataFrame:
    """Attributes of a dimension table, with a default where the key is unknown. Of several rows of a key the largest holds."""
    values = [n for n in dim.columns if n not in keys]
    one = dim.groupBy(*keys).agg(F.max(F.struct(*values)).alias("__row")).select(*keys, *[F.col(f"__row.{n}").alias(n) for n in values])
    joined = df.join(one, keys, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(d)) for n, d in defaults.items()})


def tier_of(df: DataFrame, city: str, code_list: DataFrame, default: str, out: str = "tier") -> DataFrame:
    """City tier by the user's code list (city, tier); other cities get the lowest tier, and of several tiers of a city the last list holds."""
    names = code_list.select(F.col("city").alias(city), F.col("tier").alias(out))
    return dim_join(df, names, [city], {out: default})


def preferred_match_join(
    df: DataFrame, candidates: DataFrame, keys: list[str], role: str, order: Sequence[str], hot: list[Row] | None = None
) -> DataFrame:
    """The candidate row of the most preferred role that exists for the key.

    The winner is found by an aggregate that combines map-side, so many candidates of one key
    never meet in one sort.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in order]), F.col(role))
    values = [n for n in candidates.columns if n not in keys]
    best = (
        candidates.filter(F.col(role).isin(list(order)))
        .groupBy(*keys)
        .agg(F.min(F.struct(rank.alias("__rank"), *values)).alias("__best"))
        .select(*keys, *[F.col(f"__best.{n}").alias(n) for n in values])
    )
    return lookup_join(df, best, keys, "left", hot=hot)


def slot_lookup_join(df: DataFrame, long: DataFrame, keys: list[str], slot: str, hot: list[Row] | None = None) -> DataFrame:
    """Values of the slot whose number stands in `slot`, from a long (key, slot, values) table."""
    return lookup_join(df, long, keys + [slot], "left", hot=hot)


def parent_child_merge(children: DataFrame, parents: DataFrame, keys: list[str], suffix: str = "_parent",
                       hot: list[Row] | None = None) -> DataFrame:
    return lookup_join(children, suffix_cols(parents, suffix, keys), keys, "left", hot=hot)


def interval_overlap_join(
    spells: DataFrame, windows: DataFrame, keys: list[str], spell: tuple[str, str], window: tuple[str, str],
    out: str = "overlap", hot: list[Row] | None = None,
) -> DataFrame:
    """Years each spell shares with its person's window (one row per person in `windows`)."""
    joined = lookup_join(spells, windows, keys, "left", hot=hot)
    return joined.withColumn(out, F.coalesce(overlap_years(*spell, *window), F.lit(0)))


def overlap_with_fixed(spells: DataFrame, spell: tuple[str, str], start: int, end: int, out: str = "overlap") -> DataFrame:
    return spells.withColumn(out, overlap_years(*spell, F.lit(start), F.lit(end)))


