"""Spells and yearly state sequences, as array columns of one row: no shuffle, no row loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.recode import ColumnLike, c
from hearthline.operators.household import pick_best_overlap
from hearthline.operators.link import overlap_with_fixed


def spell_years(start: ColumnLike, end: ColumnLike, open_end: int | None = None, negative: str = "ten") -> Column:
    """Length of a spell: an open end is the survey year; a negative length is a slip of the pen and
    becomes ten years ("ten"), its absolute value ("abs"; the same as swapping the ends)."""
    last = c(end) if open_end is None else F.coalesce(c(end), F.lit(open_end))
    years = last - c(start)
    fixed = F.lit(10) if negative == "ten" else F.abs(years)
    return F.when(years < 0, fixed).otherwise(years)


def normalise_spells(df: DataFrame, start: str, end: str, open_end: int) -> DataFrame:
    """Open ends closed at the survey year, ends swapped where they stand the wrong way round."""
    last = F.coalesce(F.col(end), F.lit(open_end))
    return df.withColumns({start: F.least(F.col(start), last), end: F.greatest(F.col(start), last)})


def change_points_to_spells(points: Sequence[tuple[ColumnLike, ColumnLike]], end_year: ColumnLike | int, negative: str = "ten") -> Column:
    """Array of (state, years) from (year, state) change points in order and an end marker.

    Incomplete points are dropped; a state lasts until the next change.
    """
    end = F.lit(end_year) if isinstance(end_year, int) else c(end_year)
    pairs = [F.struct(c(y).cast("int").alias("year"), c(s).cast("string").alias("state")) for y, s in points]
    known = F.filter(F.array(*pairs), lambda p: p["year"].isNotNull() & p["state"].isNotNull())
    nexts = F.concat(F.slice(F.transform(known, lambda p: p["year"]), 2, len(points)), F.array(end.cast("int")))
    both = F.arrays_zip(known.alias("p"), nexts.alias("n"))

    def spell(z: Column) -> Column:
        years = spell_years(z["p"]["year"], z["n"], negative=negative)
        return F.struct(z["p"]["state"].alias("state"), years.cast("int").alias("years"))

    return F.transform(F.slice(both, 1, F.size(known)), spell)


def fit_length(states: Column, length: int, align: str = "right") -> Column:
    """Exactly `length` states: the last ones, missing ahead ("right"), or the first ones ("left")."""
    pad = F.array_repeat(F.lit(None).cast("string"), length)
    if align == "right":
        return F.slice(F.concat(pad, states), -length, length)
    return F.slice(F.concat(states, pad), 1, length)


def spells_to_yearly(spells: Column, length: int = 100, align: str = "right") -> Column:
    """One state per year. No spell is repeated beyond `length`, more years could not show."""
    states = F.flatten(F.transform(
        spells, lambda s: F.array_repeat(s["state"], F.greatest(F.least(s["years"], F.lit(length)), F.lit(0)))))
    return fit_length(states, length, align)


def sequence_define(states: Column, window: int) -> Column:
    """The last `window` years as the sequence to analyse."""
    return F.slice(states, -window, window)


def states_to_sequence(df: DataFrame, id_col: str, pos: str, state: str, length: int, out: str = "seq") -> DataFrame:
    """Long (id, position 1..length, state), one row per position, to one array per person.

    Positions outside the window are not part of the sequence, so an array has at most `length` entries.
    """
    inside = df.filter(F.col(pos).between(1, length) & F.col(state).isNotNull())
    by_pos = F.map_from_entries(F.collect_list(F.struct(F.col(pos).cast("int"), F.col(state))))
    return inside.groupBy(id_col).agg(by_pos.alias("__m")).select(
        id_col, F.transform(F.sequence(F.lit(1), F.lit(length)), lambda p: F.try_element_at(F.col("__m"), p)).alias(out))


def spell_in_window(df: DataFrame, keys: list[str], start: str, end: str, state: str, window: tuple[int, int], tie: str) -> DataFrame:
    """Main state of a person in a window of years; without any, the state of the spell that ended first."""
    spells = overlap_with_fixed(df, (start, end), *window, "__overlap")
    best = pick_best_overlap(spells, keys, "__overlap", end, tie)
    return best.select(*keys, state, F.col("__overlap").alias("years"))
