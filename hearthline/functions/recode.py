"""Column helpers with explicit missing-value rules.

Three-valued conditions stay missing, set membership is never missing, horizontal extremes
keep missing values, text-to-number never raises.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def v(x) -> Column:
    """A value: columns stay, anything else (text too) is a literal."""
    return x if isinstance(x, Column) else F.lit(x)


# --- conditions -----------------------------------------------------------------------------


def r_ifelse(cond: Column, yes, no) -> Column:
    """Missing where the condition is missing."""
    return F.when(cond, v(yes)).when(~cond, v(no))


def case_when(*branches: tuple[Column, object], default=None) -> Column:
    """First true branch wins; a missing condition is no match; missing if nothing matches."""
    out = F
    for cond, value in branches:
        out = out.when(cond, v(value))
    return out if default is None else out.otherwise(v(default))


def mask_ladder(start: ColumnLike, *rules: tuple[Column, object]) -> Column:
    """Assignments by mask done in order on one column: a later true rule overwrites."""
    return case_when(*reversed(rules), default=c(start))


def in_set(x: ColumnLike, values: Iterable) -> Column:
    """Membership that is false, never missing, for a missing value."""
    return F.coalesce(c(x).isin(list(values)), F.lit(False))


def not_in_set(x: ColumnLike, values: Iterable) -> Column:
    """True for a missing value."""
    return ~in_set(x, values)


def is_missing(x: ColumnLike) -> Column:
    return c(x).isNull()


def not_missing(x: ColumnLike) -> Column:
    return c(x).isNotNull()


def flag_equals(x: ColumnLike, label) -> Column:
    """Label to logical; missing stays missing."""
    return c(x) == v(label)


def dichotomy(x: ColumnLike, values: Iterable, yes, no) -> Column:
    """Two-way split by membership; a missing value counts as not in the set."""
    return F.when(in_set(x, values), v(yes)).otherwise(v(no))


# --- codes and labels -----------------------------------------------------------------------


def _lookup(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(item) for pair in mapping.items() for item in pair])


def recode_labels(x: ColumnLike, mapping: Mapping, keep: bool = True) -> Column:
    """Old label to new label; others are kept, or become missing with keep=False."""
    hit = F.try_element_at(_lookup(mapping), c(x))
    return F.coalesce(hit, c(x)) if keep else hit


def recode_codes(x: ColumnLike, mapping: Mapping, keep: bool = False) -> Column:
    """Code to number. Unlisted codes become missing, or are kept with keep=True."""
    return recode_labels(x, mapping, keep)


def recode_positional(x: ColumnLike, values: Sequence, keep: bool = True) -> Column:
    """Code k becomes the k-th value; codes outside 1..n are kept (or missing)."""
    k = c(x).cast("int")
    listed = F.array(*[F.lit(item) for item in values])
    hit = F.when(k.between(1, len(values)), F.try_element_at(listed, k))
    return F.coalesce(hit, c(x)) if keep else hit


def collapse_levels(x: ColumnLike, mapping: Mapping[str, str | None]) -> Column:
    """Merge levels; a level sent to None becomes missing; others stay."""
    merged = {old: new for old, new in mapping.items() if new is not None}
    gone = [old for old, new in mapping.items() if new is None]
    out = recode_labels(x, merged) if merged else c(x)
    return F.when(not_in_set(x, gone), out)


def level_ordinal(x: ColumnLike, levels: Sequence[str]) -> Column:
    """1-based place of a label in its ordered level list; missing if not listed."""
    return recode_codes(x, {label: i for i, label in enumerate(levels, 1)})


def ordinal_label(x: ColumnLike, levels: Sequence[str]) -> Column:
    return recode_positional(x, levels, keep=False)


def na_if(x: ColumnLike, *sentinels) -> Column:
    return F.when(not_in_set(x, sentinels), c(x))


def replace_na(x: ColumnLike, value) -> Column:
    return F.coalesce(c(x), v(value))


def coalesce_waves(*newest_first: ColumnLike) -> Column:
    return F.coalesce(*map(c, newest_first))


def coalesce_pair(a: ColumnLike, b: ColumnLike) -> tuple[Column, Column]:
    """Each of two columns filled from the other."""
    return F.coalesce(c(a), c(b)), F.coalesce(c(b), c(a))


def last_present_across(*oldest_first: ColumnLike) -> Column:
    return F.coalesce(*[c(x) for x in reversed(oldest_first)])


def resolve_pair(a: ColumnLike, b: ColumnLike, defer_codes: Iterable) -> Column:
    """`b` where `a` says "changed/unified", else `a`; missing `a` stays missing."""
    return r_ifelse(c(a).isin(list(defer_codes)), c(b), c(a))


def fill_from_related(flag: Column, related: ColumnLike, own: ColumnLike) -> Column:
    """"Same as the other person": take the related value where the flag is true."""
    return F.when(flag, c(related)).otherwise(c(own))


def house_reset_if_moved(moved: Column, x: ColumnLike) -> Column:
    """Blank a value carried from an earlier wave when the household has moved since."""
    return F.when(F.coalesce(~moved, F.lit(True)), c(x))


def conditional_zero(flag: Column, x: ColumnLike) -> Column:
    """0 where the flag is false, missing where the flag is missing."""
    return r_ifelse(flag, c(x), F.lit(0).cast("double"))


# --- numbers --------------------------------------------------------------------------------


def clip_low(x: ColumnLike, low) -> Column:
    return F.when(c(x).isNotNull() & v(low).isNotNull(), F.greatest(c(x), v(low)))


def clip_high(x: ColumnLike, high) -> Column:
    return F.when(c(x).isNotNull() & v(high).isNotNull(), F.least(c(x), v(high)))


def negative_to_null(x: ColumnLike) -> Column:
    return F.when(c(x) >= 0, c(x))


def fix_units(x: ColumnLike, rules: Sequence[tuple[str, float, str, float]]) -> Column:
    """Magnitude repair by ordered rules (test, limit, action, value); the first that fits wins.

    test is ">" or ">=", action is "divide" or "set".
    """
    x = c(x)
    branches = []
    for test, limit, action, value in rules:
        hit = {">": x > limit, ">=": x >= limit}[test]
        branches.append((hit, {"divide": x / F.lit(value), "set": F.lit(value)}[action]))
    return case_when(*branches, default=x)


def log_shift(x: ColumnLike, shift: float = 0.0, floor: float | None = None) -> Column:
    """ln(max(x, floor) + shift); missing where the argument is not positive."""
    base = c(x) if floor is None else clip_low(x, F.lit(floor))
    return F.log(base + F.lit(shift))


def exp_unshift(x: ColumnLike, shift: float = 0.0) -> Column:
    return F.exp(c(x)) - F.lit(shift)


def zero_flag(x: ColumnLike) -> Column:
    return (c(x) <= 0).cast("int")


def scale_units(x: ColumnLike, k: float) -> Column:
    return c(x) * F.lit(k)


def reverse_code(x: ColumnLike, top: int) -> Column:
    return F.lit(top + 1) - c(x)


def age_at(year, birth_year: ColumnLike) -> Column:
    return v(year) - c(birth_year)


def year_gap(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Years between two answers that may be text."""
    return c(later).try_cast("int") - c(earlier).try_cast("int")


def round_report(x: ColumnLike, digits: int) -> Column:
    return F.round(c(x), digits)


def bands(x: ColumnLike, ranges: Sequence[tuple[float, float, str]]) -> Column:
    """Closed intervals to labels, first hit wins, missing outside all of them."""
    return case_when(*[(c(x).between(lo, hi), label) for lo, hi, label in ranges])


def cut(x: ColumnLike, breaks: Sequence, labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Right-closed intervals (b0,b1], (b1,b2], ...; the lowest edge belongs only on request."""
    x = c(x)
    first_low = (x >= v(breaks[0])) if include_lowest else (x > v(breaks[0]))
    branches = []
    for i, label in enumerate(labels):
        low = first_low if i == 0 else x > v(breaks[i])
        branches.append((low & (x <= v(breaks[i + 1])), label))
    return case_when(*branches)


# --- horizontal sums ------------------------------------------------------------------------


def row_sum(*cols: ColumnLike, na_zero: bool = False) -> Column:
    parts = [F.coalesce(c(x), F.lit(0)) if na_zero else c(x) for x in cols]
    return reduce(lambda a, b: a + b, parts)


def row_count_positive(*cols: ColumnLike) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c(x) > 0, 1).otherwise(0) for x in cols])


def weighted_row_sum(weights: Mapping[str, float], na_zero: bool = True) -> Column:
    """Σ weight·column; 12·monthly + yearly is the common use."""
    part = lambda n: F.coalesce(c(n), F.lit(0.0)) if na_zero else c(n)
    return reduce(lambda a, b: a + b, [part(n) * F.lit(float(w)) for n, w in weights.items()])


def net_worth(assets: Sequence[ColumnLike], debts: Sequence[ColumnLike]) -> Column:
    return row_sum(*assets, na_zero=True) - row_sum(*debts, na_zero=True)
