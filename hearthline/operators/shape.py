"""Choosing, naming and ordering columns; wide to long and back; stacking tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- columns --------------------------------------------------------------------------------


def select_rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """{new name: old name}"""
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def drop_cols(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def col_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from `first` to `last` in table order, both included."""
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def cols_matching(df: DataFrame, pattern: str) -> list[str]:
    return [n for n in df.columns if re.search(pattern, n)]


def col_setdiff(a: Iterable[str], b: Iterable[str]) -> list[str]:
    gone = set(b)
    return [n for n in a if n not in gone]


def mutate(df: DataFrame, **cols: Column) -> DataFrame:
    return df.withColumns(cols)


def transmute(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select(*[col.alias(n) for n, col in cols.items()])


def mutate_at(df: DataFrame, cols: Iterable[str], f: Callable[[Column], Column], suffix: str = "") -> DataFrame:
    """The same function over several columns, into copies with a suffix or in place."""
    return df.withColumns({n + suffix: f(F.col(n)) for n in cols})


def mutate_if(df: DataFrame, data_type: type[T.DataType], f: Callable[[Column], Column]) -> DataFrame:
    """The same function over all columns of one type."""
    return df.withColumns({s.name: f(F.col(s.name)) for s in df.schema if isinstance(s.dataType, data_type)})


def cast_all(df: DataFrame, cols: Iterable[str], to: str) -> DataFrame:
    """Cast that gives missing, not an error, for what is no value of the type."""
    return df.withColumns({n: F.col(n).try_cast(to) for n in cols})


def ensure_cols(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Add the columns ({name: type}) that this wave lacks, as missing."""
    lacking = {n: F.lit(None).cast(t) for n, t in cols.items() if n not in df.columns}
    return df.withColumns(lacking) if lacking else df


def suffix_cols(df: DataFrame, suffix: str, keep: Iterable[str] = ()) -> DataFrame:
    kept = set(keep)
    return df.withColumnsRenamed({n: n + suffix for n in df.columns if n not in kept})


def reorder_cols(df: DataFrame, first: Sequence[str]) -> DataFrame:
    return df.select(*first, *col_setdiff(df.columns, first))


def head(df: DataFrame, n: int = 6, order: Sequence[Column] = ()) -> DataFrame:
    """A preview; ordered if the rows shown should be the same every time."""
    return (df.orderBy(*order) if order else df).limit(n)


# --- rows -----------------------------------------------------------------------------------


def union_all(*dfs: DataFrame) -> DataFrame:
    """Stack tables by column name; columns one of them lacks are missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def append_summary_row(df: DataFrame, values: DataFrame | Mapping[str, object]) -> DataFrame:
    """Add a computed row: a one-row table, or literal values."""
    if not isinstance(values, DataFrame):
        row = [F.lit(values.get(s.name)).cast(s.dataType).alias(s.name) for s in df.schema]
        values = df.sparkSession.range(1).select(*row)
    return union_all(df, values)


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=cols)


def keep_if_any_present(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop("all", subset=cols)


# --- long and wide --------------------------------------------------------------------------


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str = "key", value: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def slot_from_name(x: Column | str, pattern: str = r"(\d+)_?$") -> Column:
    """Slot number at the end of a column name, any number of digits."""
    col = F.col(x) if isinstance(x, str) else x
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit("")).cast("int")


def unpivot_blocks(
    df: DataFrame,
    ids: list[str],
    stems: Mapping[str, str],
    slots: Iterable[int],
    name: str = "slot",
    drop_empty: bool = True,
) -> DataFrame:
    """Repeated blocks `stem<slot>` to one row per slot, all stems at once, without a shuffle.

    `stems` is {new column: name pattern with {}}. A slot that a wave lacks is missing; rows in
    which every value is missing are dropped.
    """
    have = {s.name: s.dataType for s in df.schema}
    types = {
        new: next((have[p.format(s)] for s in slots if p.format(s) in have), T.StringType())
        for new, p in stems.items()
    }

    def field(new: str, pattern: str, slot: int) -> Column:
        col = F.col(pattern.format(slot)) if pattern.format(slot) in have else F.lit(None)
        return col.cast(types[new]).alias(new)

    rows = [F.struct(F.lit(s).alias(name), *[field(n, p, s) for n, p in stems.items()]) for s in slots]
    long = df.select(*ids, F.inline(F.array(*rows)))
    return keep_if_any_present(long, list(stems)) if drop_empty else long


def array_block_to_rows(df: DataFrame, ids: list[str], pattern: str, slots: Iterable[int], value: str) -> DataFrame:
    """One stem's slots to rows, empty ones dropped."""
    return unpivot_blocks(df, ids, {value: pattern}, slots)


def slot_lookup(slot: Column | str, columns: Mapping[int, str]) -> Column:
    """The wide column whose slot number stands in another column."""
    options = F.create_map(*[item for s, n in columns.items() for item in (F.lit(s), F.col(n))])
    return F.try_element_at(options, F.col(slot) if isinstance(slot, str) else slot)


def pivot_counts(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Counts with the levels of `col` as columns; the level list is given, so no extra scan."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)


def bind_cols_by_key(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Put columns side by side by key, never by position."""
    return left.join(right, keys, how)


def bind_tables_side_by_side(tables: Mapping[str, DataFrame], on: list[str]) -> DataFrame:
    """Report tables with the same row labels next to each other; columns get the table's name."""
    named = [
        t.select(*on, *[F.col(n).alias(f"{label}_{n}") for n in t.columns if n not in on])
        for label, t in tables.items()
    ]
    return reduce(lambda a, b: a.join(b, on, "outer"), named)
