"""Derived survey columns: home values, brackets, jobs, schooling episodes, couple roles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline.functions import codebook
from hearthline.functions.recode import ColumnLike, c, case_when, in_set, r_ifelse, v


def bracket_midpoint(exact: ColumnLike, high: ColumnLike, low: ColumnLike) -> Column:
    """exact + (high + low)/2, each missing part counted as 0."""
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    return zero(exact) + (zero(high) + zero(low)) / 2


def bracket_fallback(low: ColumnLike, high: ColumnLike) -> Column:
    """Mean of both ends, else the one that is known."""
    return F.coalesce((c(low) + c(high)) / 2, c(low), c(high))


def property_value(
    given: ColumnLike,
    total: ColumnLike,
    unit: ColumnLike,
    area: ColumnLike,
    low: ColumnLike,
    high: ColumnLike,
    prior: ColumnLike | None = None,
) -> Column:
    """Value of one home slot, in 10 000 currency units.

    If a new value was given: the total, else unit price (1 000/m²) times area, else the middle of
    the unit-price bracket times area. If not: the value of the earlier wave. Missing counts as 0.
    """
    fresh = F.coalesce(
        c(total), c(unit) * c(area) / 10, (c(low) + c(high)) / 2 * c(area) / 10000
    )
    old = F.lit(None).cast("double") if prior is None else c(prior)
    return F.coalesce(F.when(c(given).isNotNull(), fresh).otherwise(old), F.lit(0.0))


def job_detail_cascade(status: ColumnLike, sector: ColumnLike, firm: ColumnLike,
                       employed: Sequence[str] = codebook.JOB_EMPLOYED,
                       firm_labels: Sequence[str] = codebook.JOB_FIRM) -> Column:
    """Employed people go by sector, those in firms by firm type; all others by status."""
    return F.when(
        in_set(status, employed), F.when(in_set(sector, firm_labels), c(firm)).otherwise(c(sector))
    ).otherwise(c(status))


def classify_state(job: ColumnLike, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Job label to one letter of a small state alphabet."""
    state = F.try_element_at(F.create_map(*[F.lit(i) for kv in mapping.items() for i in kv]), c(job))
    return state if default is None else F.coalesce(state, F.lit(default))


def employment_class(status: ColumnLike, sector: ColumnLike, owner: ColumnLike) -> Column:
    """Public or Private: by sector, by owner where the sector does not tell."""
    employed = case_when(
        (in_set(sector, codebook.PUBLIC_SECTORS), "Public"),
        (in_set(sector, codebook.PRIVATE_SECTORS), "Private"),
        (in_set(owner, codebook.PUBLIC_OWNERS), "Public"),
        default="Private",
    )
    return r_ifelse(c(status) == "3", employed, "Private")


def annualise(job: ColumnLike, monthly_by_job: Mapping[str, ColumnLike], unpaid: Sequence[str] = ()) -> Column:
    """12 × the monthly pay column that belongs to the job type; unpaid jobs earn 0."""
    branches = [(in_set(job, [label]) & c(pay).isNotNull(), c(pay) * 12) for label, pay in monthly_by_job.items()]
    return case_when(*branches, (in_set(job, unpaid), F.lit(0.0)))


def episode_flags(episodes: Column, kinds: Sequence[str], key_schools: Sequence[str]) -> Column:
    """Over an array of (kind, school): true if any episode of these kinds was at a key school,
    false if only at others or at an unnamed one, missing if there was none."""
    mine = F.filter(episodes, lambda e: e["kind"].isin(list(kinds)))
    return F.when(F.size(mine) > 0, F.exists(mine, lambda e: F.coalesce(e["school"].isin(list(key_schools)), F.lit(False))))


def dropout_fill(flag: ColumnLike, years: ColumnLike, level: str) -> Column:
    """Fill a missing key-school flag (text) with "dropout" when schooling ended before the level."""
    limit, strict = codebook.DROPOUT_LIMITS[level]
    short = c(years) < limit if strict else c(years) <= limit
    branches = [(c(flag).isNotNull(), c(flag)), (short, "dropout")]
    if level == "high":
        branches.append((c(years) == 11, "FALSE"))
    return case_when(*branches)


def swap_roles(is_male: Column, names: Sequence[str], own: str = "res", other: str = "sps",
               husband: str = "husb", wife: str = "wife") -> dict[str, Column]:
    """Respondent/spouse columns to husband/wife columns; missing sex gives missing."""
    out = {}
    for n in names:
        mine, theirs = F.col(f"{n}_{own}"), F.col(f"{n}_{other}")
        out[f"{n}_{husband}"] = r_ifelse(is_male, mine, theirs)
        out[f"{n}_{wife}"] = r_ifelse(is_male, theirs, mine)
    return out


def birth_position(n_children: ColumnLike, child_no: ColumnLike) -> Column:
    return case_when(
        (c(n_children) == 1, "only child"), (c(child_no) == 1, "first child"), (c(child_no) > 1, "later child")
    )


def nearest_before_slot(starts: Sequence[tuple[str, ColumnLike]], limit, default: str = "1") -> Column:
    """Wide form: slot whose year lies closest before `limit`.

    Only a smallest gap held by one slot counts; nobody or a tie gives `default`.
    """
    gaps = F.array(*[
        F.struct((v(limit) - c(year)).alias("gap"), F.lit(slot).alias("slot")) for slot, year in starts
    ])
    ahead = F.filter(gaps, lambda g: g["gap"] > 0)
    best = F.array_min(F.transform(ahead, lambda g: g["gap"]))
    winners = F.filter(ahead, lambda g: g["gap"] == best)
    return F.when(F.size(winners) == 1, F.try_element_at(winners, F.lit(1))["slot"]).otherwise(F.lit(default))


def overlap_years(s1: ColumnLike, e1: ColumnLike, s2: ColumnLike, e2: ColumnLike) -> Column:
    """Years two closed intervals share, 0 if none."""
    shared = F.least(c(e1), c(e2)) - F.greatest(c(s1), c(s2)) + 1
    known = c(s1).isNotNull() & c(e1).isNotNull() & c(s2).isNotNull() & c(e2).isNotNull()
    return F.when(known, F.greatest(shared, F.lit(0)))
