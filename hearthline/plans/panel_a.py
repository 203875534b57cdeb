"""Parents and children: from raw person, household, child and transfer tables to the analysis table.

One lazy graph of joins on household and person keys. Wide question blocks are turned to rows
inside a row, so the only shuffles are those of the roll-ups and joins. Column names are those of
the caller's tables; what differs between surveys is an argument.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hearthline.functions import codebook, household as H, recode as R
from hearthline.operators import household as HH, link, shape
from hearthline.operators.impute import complete, impute_mice_rf
from hearthline.operators.tables import cross_tab_wide


def job_at_age(work: DataFrame, id_col: str, birth_year: str, start: str, status: str, sector: str, firm: str,
               ranks: Sequence[str], slots: Sequence[int], age: int = 40) -> DataFrame:
    """(id, job, manager): details of the job begun last before `age`; patterns hold {} for the slot."""
    have = set(work.columns)
    limit = F.col(birth_year) + age
    slot = H.nearest_before_slot([(str(s), start.format(s)) for s in slots if start.format(s) in have], limit)

    def at(pattern: str) -> Column:
        columns = {s: pattern.format(s) for s in slots if pattern.format(s) in have}
        return shape.slot_lookup(F.col("__slot"), columns) if columns else F.lit(None).cast("string")

    chosen = work.withColumn("__slot", slot.cast("int"))
    job = H.job_detail_cascade(at(status), at(sector), at(firm))
    return chosen.select(
        id_col, R.recode_labels(job, codebook.JOB_SECTOR).alias("job"), R.coalesce_waves(*map(at, ranks)).alias("manager"))


def household_finance(incomes: DataFrame, hhid: str, items: Mapping[str, tuple[str, str, str]],
                      debts: Mapping[str, tuple[str, str, str]], out: str = "asset_fin") -> DataFrame:
    """Σ over members of assets − debts; each item is (exact, upper, lower bound) and counts as midpoint."""
    mid = lambda parts: [H.bracket_midpoint(*p) for p in parts.values()]
    net = R.net_worth(mid(items), mid(debts))
    return HH.group_sum(incomes.select(hhid, net.alias(out)), [hhid], [out])


def land_and_durables(assets: DataFrame, hhid: str, land: Sequence[str], durables: Sequence[str], land_factor: float = 20.0) -> DataFrame:
    return assets.select(
        hhid, R.weighted_row_sum({c: land_factor for c in land}).alias("asset_land"),
        R.weighted_row_sum({c: 1.0 for c in durables}).alias("asset_durable"))


@dataclass(frozen=True)
class HomeBlock:
    """Name patterns ({} = slot) of one block of homes; `prior` is the value of the earlier wave."""

    slots: Sequence[int]
    given: str
    total: str
    unit: str
    area: str
    low: str
    high: str
    prior: str | None = None


def home_wealth(housing: DataFrame, hhid: str, blocks: Sequence[HomeBlock]) -> DataFrame:
    """(hhid, asset_home, num_home) over all home slots; unit slips are repaired first."""
    have = {s.name for s in housing.schema}

    def number(pattern: str | None, slot: int) -> Column:
        name = pattern and pattern.format(slot)
        return F.col(name).try_cast("double") if name in have else F.lit(None).cast("double")

    values = []
    for b in blocks:
        for s in b.slots:
            high, low = R.coalesce_pair(number(b.high, s), number(b.low, s))
            values.append(H.property_value(
                F.col(b.given.format(s)) if b.given.format(s) in have else F.lit(None),
                R.fix_units(number(b.total, s), codebook.TOTAL_VALUE_RULES),
                R.fix_units(number(b.unit, s), codebook.UNIT_PRICE_RULES), number(b.area, s), low, high, number(b.prior, s)))
    slots = F.array(*values)
    return housing.select(hhid, slots.alias("__v")).select(
        hhid, (F.aggregate("__v", F.lit(0.0), lambda a, v: a + v) * 10000).alias("asset_home"),
        F.size(F.filter("__v", lambda v: v > 0)).alias("num_home"))


def parents(persons: DataFrame, attributes: Sequence[DataFrame], households: Sequence[DataFrame], id_col: str, hhid: str,
            role: str, role_order: Sequence[str], suffix: str = "_parent") -> DataFrame:
    """Householders with their own attributes and their household's wealth, named as parents."""
    people = link.person_attr_join(persons, attributes, [id_col])
    heads = HH.householder(people, [hhid], role, role_order, id_col)
    return shape.suffix_cols(link.full_join([heads, *households], [hhid]), suffix, [hhid])


def children(family: DataFrame, hhid: str, stems: Mapping[str, str], slots: Sequence[int],
             transfers: Sequence[tuple[DataFrame, Mapping[str, str]]] = (), child: str = "childid") -> DataFrame:
    """One row per child from the wide family table, with the transfers to that child."""
    kids = shape.unpivot_blocks(family, [hhid], stems, slots, child)
    for wide, parts in transfers:
        kids = link.left_join(kids, shape.unpivot_blocks(wide, [hhid], parts, slots, child), [hhid, child])
    return kids


def merged(kids: DataFrame, heads: DataFrame, hhid: str, same_as: Mapping[str, tuple[Column, str]],
           hot: list[Row] | None = None) -> DataFrame:
    """Children with their parents; an answer "same as respondent" takes the parent's value."""
    both = link.left_join(kids, heads, [hhid], hot=hot)
    return both.withColumns({c: R.fill_from_related(flag, other, c) for c, (flag, other) in same_as.items()})


def analysis_table(rows: DataFrame, hhid: str, child: str, age: str, conditions: Sequence[Column], wealth: Sequence[str],
                   income: Sequence[str], seed: int | None = None, hot: list[Row] | None = None) -> DataFrame:
    """Sibling rank and size, sample filter, one child per household if wanted, logs and flags.

    Joining parents does not change how many children a household has, so `hot` may come from the
    child table (`skew.hot_groups(kids, [hhid])`) before that join.
    """
    ranked = HH.sibling_rank(rows, [hhid], [F.col(age).desc_nulls_last(), F.col(child).asc()], hot=hot)
    kept = HH.group_size_col(ranked, [hhid], "sibling_n", hot=hot)
    for cond in conditions:
        kept = kept.filter(cond)
    if seed is not None:
        kept = HH.sample_one(kept, [hhid], [hhid, child], seed)
    logged = shape.mutate_at(kept, wealth, lambda x: R.log_shift(x, 1, floor=0.0), "_logged")
    logged = shape.mutate_at(logged, income, lambda x: R.log_shift(x, 50), "_logged")
    return shape.mutate_at(logged, wealth, R.zero_flag, "_zero")


def completed(rows: DataFrame, id_col: str, cols: Sequence[str], zeros: Mapping[str, Column], totals: Mapping[str, Sequence[str]],
              maxit: int = 30, seed: int = 999) -> DataFrame:
    """The sample with values put to 0 where they cannot be (`zeros`: column -> whether it can), then missing values of
    `cols` filled by chained forests, then `totals` as sums of completed columns."""
    ready = rows.withColumns({c: R.conditional_zero(can, c) for c, can in zeros.items()})
    full = complete(impute_mice_rf(ready, id_col, cols, m=1, maxit=maxit, seed=seed))
    return full.withColumns({out: reduce(lambda a, b: a + b, [F.col(c) for c in parts]) for out, parts in totals.items()})


def wealth_report(table: DataFrame, wealth: str, outcome: str, levels: Sequence[str]) -> DataFrame:
    """Outcome by quartile of parental wealth, row percents and p-value."""
    labels = ["0-25%", "25-50%", "50-75%", "75-100%"]
    binned = HH.quantile_bin(table, wealth, [0, 0.25, 0.5, 0.75, 1], labels, out=f"{wealth}_quant")
    return cross_tab_wide(binned, f"{wealth}_quant", outcome, levels)
