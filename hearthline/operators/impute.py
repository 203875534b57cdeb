"""Filling missing values: constants, medians, and chained equations with donors.

Donors are real rows: the nearest by prediction, found in ranges of predictions that are merged one by one, or members of the same
leaves of a forest, found in random blocks of the table. No list of all donors or predictions is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthline.functions.recode import level_ordinal
from hearthline.operators.forest import impute_forest
from hearthline.operators.household import group_median
from hearthline.operators.models import cross_products, factor_levels
from hearthline.operators.skew import hot_groups, lookup_join, running_total, shuffle_partitions
from hearthline.session import stable, stored

# --- simple fills ---------------------------------------------------------------------------


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in values.items()})


def fill_median(df: DataFrame, x: str, where: Column) -> DataFrame:
    """Missing values: the column's median where the condition holds, else 0."""
    middle = group_median(df.select(x), [], x).scalar()
    return df.withColumn(x, F.coalesce(F.col(x), F.when(where, middle), F.lit(0.0)))


def complete(imputed: DataFrame, k: int = 1) -> DataFrame:
    """The k-th completed table."""
    return imputed.filter(F.col("imp") == k).drop("imp")


# --- first draws ----------------------------------------------------------------------------


def _draw(donors: DataFrame, takers: DataFrame, id_col: str, value: str, seed: int, hot: list[Row]) -> DataFrame:
    """(id, copy, value): for each taker of each copy the value of a donor drawn by seeded hashes."""
    order = [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)]
    numbered = running_total(donors.select(id_col, value), [], order, "__pos", hot=hot).select("__pos", value)
    n = donors.agg(F.count(F.lit(1))).scalar()
    wanted = takers.select(id_col, "__copy", (F.pmod(F.xxhash64(F.col(id_col), F.col("__copy"), F.lit(seed + 1)), n) + 1).alias("__pos"))
    # with few donors each is wanted by many
    return lookup_join(wanted, numbered, ["__pos"], "inner", hot=None if hot else []).select(id_col, "__copy", value)


# --- donors by nearest prediction ----------------------------------------------------------


def _bounds(rows: DataFrame, parts: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(prediction, tie) at which each copy is cut into `parts` ranges of about equal size; equal predictions are cut by their ties."""
    if parts < 2:
        return {}
    places = F.percentile_approx("__hat", [i / parts for i in range(1, parts)], F.lit(20 * parts))
    out = {}
    for r in rows.groupBy("__copy").agg(places.alias("q")).collect():
        hats = np.array(r["q"], float)
        first, turn = np.searchsorted(hats, hats, "left"), np.arange(len(hats))
        many = np.searchsorted(hats, hats, "right") - first
        share = (turn - first + 1) / (many + 1)
        out[r["__copy"]] = (hats, np.where(many > 1, (share * 2.0**64 - 2.0**63), -(2.0**63)).astype(np.int64))
    return out


def _range_of(bounds: tuple[np.ndarray, np.ndarray] | None, hat: np.ndarray, tie: np.ndarray) -> np.ndarray:
    if bounds is None:
        return np.zeros(len(hat), np.int64)
    cuts, ties = bounds
    low, high = np.searchsorted(cuts, hat, "left"), np.searchsorted(cuts, hat, "right")
    tied = np.flatnonzero(low < high)
    tied = tied[np.argsort(low[tied], kind="stable")]
    for own in np.split(tied, np.flatnonzero(np.diff(low[tied])) + 1) if len(tied) else []:  # rows that share a prediction with cuts
        a, b = low[own[0]], high[own[0]]
        low[own] = a + np.searchsorted(ties[a:b], tie[own], "right")
    return low


PACK_ROWS = 1 << 20  # donors that a task holds at once


def nearest_match(rows: DataFrame, value: str, donors: int, parts: int, more: DataFrame | None = None, every: int = 1) -> DataFrame:
    """The rows with `__own`, those without a `value` (`__known` is false) filled from one of the `donors` known rows of their copy nearest by `__hat`.

    `__tie` orders equal predictions and `__turn` says which of the donors is taken. `more` has further donors that are the same in all copies: their
    `value`, and `__hats` and `__ties` with an entry for each copy (from 1). Each copy is cut into ranges of (prediction, tie); each range
    gets the nearest donors of the ranges before and behind it, and is merged by itself. Donors travel as lists, one for each range and task, and of the
    other rows only those without a value travel. Only the ends of ranges are gathered by copy. Where ranges are cut is decided by about one prediction
    in `every`; the donors found do not depend on it.
    """
    hats = rows.filter(F.pmod("__tie", F.lit(every)) == 0).select("__copy", "__hat")
    if more is not None:
        some = more.filter(F.pmod(F.col("__ties")[0], F.lit(every)) == 0).select(F.posexplode("__hats").alias("__copy", "__hat"))
        hats = hats.unionByName(some.withColumn("__copy", F.col("__copy") + 1))
    bounds = _bounds(hats, parts)
    names = rows.columns
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    listed = lambda cols: ", ".join(f"`{c}` {kinds[c]}" for c in cols)
    end = ["__copy", "__part", "__hat", "__tie", value]
    flat = f"`__copy` {kinds['__copy']}, __part long, {listed(end[2:])}"
    lists = f"`__copy` {kinds['__copy']}, __part long, " + ", ".join(f"`{c}` array<{kinds[c]}>" for c in end[2:])

    @F.pandas_udf("long")
    def part_of(copy: pd.Series, hat: pd.Series, tie: pd.Series) -> pd.Series:
        copy, hat, tie = copy.to_numpy(), hat.to_numpy(), tie.to_numpy()
        part = np.zeros(len(copy), np.int64)
        for k in np.unique(copy):
            part[copy == k] = _range_of(bounds.get(int(k)), hat[copy == k], tie[copy == k])
        return pd.Series(part)

    part = part_of("__copy", "__hat", "__tie") if parts > 1 else F.lit(0).cast("long")

    def ends(table: pa.Table) -> pa.Table:
        copy, part, hat, tie = (np.asarray(table.column(c)) for c in end[:4])
        order = np.lexsort((tie, hat, copy))  # ranges of a copy follow one another
        copy, part = copy[order], part[order]
        new = np.flatnonzero(np.append(True, (copy[1:] != copy[:-1]) | (part[1:] != part[:-1])))[: len(copy)]
        edge = np.append(new, len(copy))
        take = [np.unique(np.r_[a : min(a + donors, b), max(a, b - donors) : b]) for a, b in zip(edge, edge[1:])]
        return table.take(pa.array(order[np.concatenate(take)] if take else np.zeros(0, np.int64)))

    def tables(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def of_rows(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """(copy, ranges, predictions, ties, values) of known rows."""
        copy, hat, tie = (np.asarray(table.column(c)) for c in ("__copy", "__hat", "__tie"))
        taken = table.column(value).combine_chunks()
        for k in np.unique(copy).tolist():
            at = np.flatnonzero(copy == k)
            yield k, _range_of(bounds.get(k), hat[at], tie[at]), hat[at], tie[at], taken.take(pa.array(at))

    def of_more(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        n, taken = table.num_rows, table.column(value).combine_chunks()
        hat, tie = (np.asarray(table.column(c).combine_chunks().flatten()).reshape(n, -1) for c in ("__hats", "__ties"))
        for k in range(hat.shape[1]):
            mine, turn = np.ascontiguousarray(hat[:, k]), np.ascontiguousarray(tie[:, k])
            yield k + 1, _range_of(bounds.get(k + 1), mine, turn), mine, turn, taken

    def columns(copy: np.ndarray, part: np.ndarray, *rest) -> dict:
        return dict(zip(end, [pa.array(copy, copies), pa.array(part, pa.int64()), *rest]))

    copies = to_arrow_schema(rows.select("__copy").schema).field(0).type

    def ends_of(by_copy, most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = []
            for table in tables(batches, most):
                for k, part, hat, tie, taken in by_copy(table):
                    held.append(ends(pa.table(columns(np.full(len(part), k), part, pa.array(hat), pa.array(tie), taken))))
            if held:
                yield from ends(pa.concat_tables(held)).combine_chunks().to_batches()

        return run

    def in_lists(by_copy, most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in tables(batches, most):
                for k, part, hat, tie, taken in by_copy(table):
                    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
                    part = part[order]
                    new = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                    edge = pa.array(np.append(new, len(part)), pa.int32())
                    parted = [pa.ListArray.from_arrays(edge, x) for x in (pa.array(hat[order]), pa.array(tie[order]), taken.take(pa.array(order)))]
                    yield pa.RecordBatch.from_pydict(columns(np.full(len(new), k), part[new], *parted))

        return run

    def exchange(table: pa.Table) -> pa.Table:
        """The ends of all ranges of a copy -> for each range the donors next to it."""
        table = ends(table.combine_chunks())
        part = np.asarray(table.column("__part"))
        take, edge = [], [0]
        for k in range(parts):
            a, b = np.searchsorted(part, k, "left"), np.searchsorted(part, k, "right")
            take.append(np.r_[max(0, a - donors) : a, b : min(len(part), b + donors)])
            edge.append(edge[-1] + len(take[-1]))
        near = table.take(pa.array(np.concatenate(take))).combine_chunks()
        parted = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), near.column(c).combine_chunks()) for c in end[2:]]
        return pa.table(columns(np.full(parts, table.column("__copy")[0].as_py()), np.arange(parts), *parted))

    def merge(mine: pa.Table, near: pa.Table) -> pa.Table:
        if not mine.num_rows:  # a range may have donors alone
            return empty
        mine = mine.combine_chunks()
        hat, tie = np.asarray(mine.column("__hat")), np.asarray(mine.column("__tie"))
        pool = pa.table({c: pc.list_flatten(near.column(c)) for c in end[2:]}).combine_chunks()
        pool = pool.take(pa.array(np.lexsort((np.asarray(pool.column("__tie")), np.asarray(pool.column("__hat"))))))
        given, given_tie = np.asarray(pool.column("__hat")), np.asarray(pool.column("__tie"))
        if not len(given):
            return mine.select(names)
        both = np.lexsort((np.r_[given_tie, tie], np.r_[given, hat]))
        place = np.cumsum(both < len(given))[np.argsort(both)][len(given) :]
        reach = place[:, None] + np.arange(-donors, donors)
        gap = np.where((reach >= 0) & (reach < len(given)), np.abs(given[np.clip(reach, 0, len(given) - 1)] - hat[:, None]), np.inf)
        order = np.argsort(gap, axis=1, kind="stable")[:, :donors]
        many = np.minimum(donors, np.isfinite(gap).sum(1))
        turn = np.asarray(mine.column("__turn")) % np.maximum(many, 1)
        choice = np.take_along_axis(reach, np.take_along_axis(order, turn[:, None], 1), 1)[:, 0]
        filled = pool.column(value).take(pa.array(choice)).combine_chunks().cast(empty.schema.field(value).type)
        return mine.set_column(names.index(value), value, filled).select(names)

    keys = ["__copy", "__part"]
    empty = to_arrow_schema(rows.schema).empty_table()
    known = rows.filter("__known").select("__copy", *end[2:])
    given = [(known, of_rows, PACK_ROWS)] + ([(more.select("__hats", "__ties", value), of_more, PACK_ROWS // 4)] if more is not None else [])
    near = [d.mapInArrow(in_lists(by_copy, most), lists) for d, by_copy, most in given]
    if parts > 1:
        found = reduce(DataFrame.unionByName, [d.mapInArrow(ends_of(by_copy, most), flat) for d, by_copy, most in given])
        near.append(found.groupBy("__copy").applyInArrow(exchange, lists))
    takers = rows.filter("__own AND NOT __known").withColumn("__part", part)
    filled = takers.groupBy(*keys).cogroup(reduce(DataFrame.unionByName, near).groupBy(*keys)).applyInArrow(merge, listed(names))
    return filled.unionByName(rows.filter("__own AND __known"))


# --- chained equations ----------------------------------------------------------------------

PART_ROWS = 1 << 14  # rows in a range of predictions
CUT_ROWS = 1 << 8  # rows of which one says where ranges are cut, about 64 for a range


def _columns(base: DataFrame, cols: Sequence[str]) -> tuple[list[str], list[str], dict[str, list[str]]]:
    """(columns with any value, those of them with holes, levels of labels); a column without any value stays missing and predicts nothing."""
    counts = base.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    known = {c: counts[f"c{i}"] for i, c in enumerate(cols)}
    cols = [c for c in cols if known[c]]
    levels = {c: factor_levels(base, c) for c in cols if isinstance(base.schema[c].dataType, (T.StringType, T.BooleanType))}
    return cols, [c for c in cols if known[c] < counts["n"]], levels


@dataclass
class _Design:
    """All columns as numbers: numeric ones as they are, labels as indicators of all levels but the first, and by their rank as responses."""

    terms: list[Column]
    of: dict[str, list[int]]  # places of a column's terms as a predictor
    response: dict[str, int]

    @staticmethod
    def of_columns(cols: Sequence[str], levels: Mapping[str, list[str]]) -> _Design:
        terms, of, response = [], {}, {}
        for c in cols:
            here = [(F.col(c).cast("string") == lv).cast("double") for lv in levels[c][1:]] if c in levels else [F.col(c).cast("double")]
            of[c] = list(range(len(terms), len(terms) + len(here)))
            terms += here
        for c in cols:
            response[c] = of[c][0] if c not in levels else len(terms)
            if c in levels:
                terms.append(level_ordinal(c, levels[c]).cast("double"))
        return _Design(terms, of, response)


def _drawn_line(s: np.ndarray, y: int, xs: list[int], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (constant first) from sums of products of (1, x): fitted, for donors, and drawn, for takers."""
    n, means = s[0, 0], s[0] / max(s[0, 0], 1)
    cov = s / max(n, 1) - np.outer(means, means)
    places = [x + 1 for x in xs]
    sxx, sxy, syy = cov[np.ix_(places, places)], cov[places, y + 1], cov[y + 1, y + 1]
    sxx = sxx + 1e-5 * np.diag(np.diag(sxx)) + 1e-12 * np.eye(len(xs))
    b = np.linalg.solve(sxx, sxy)
    rss = max(n * (syy - b @ sxy), 1e-12)
    sigma = np.sqrt(rss / rng.chisquare(max(n - len(xs) - 1, 1)))
    drawn = b + sigma * np.linalg.cholesky(np.linalg.inv(sxx * max(n, 1))) @ rng.standard_normal(len(b))
    return tuple(np.append(means[y + 1] - c @ means[places], c) for c in (b, drawn))


def _line(lines: Sequence[np.ndarray], terms: Sequence[Column], center: Sequence[float], copy: int | None = None) -> Column:
    """The prediction with the coefficients of a copy (from 1), or of the row's own."""
    of = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("__copy")) if copy is None else F.lit(float(values[copy - 1]))
    return sum((of([c[i + 1] for c in lines]) * (x - F.lit(float(m))) for i, (x, m) in enumerate(zip(terms, center))), of([c[0] for c in lines]))


def _pmm_step(state: DataFrame, whole: DataFrame, c: str, design: _Design, fixed: np.ndarray, center: np.ndarray, m: int, donors: int, parts: int, seed: int, id_col: str) -> DataFrame:
    """All copies with the holes of column `c` filled anew."""
    gone = f"__gone_{c}"
    sums = cross_products(state.filter(~F.col(gone)), design.terms, center, F.col("__copy"))
    xs = [i for o, places in design.of.items() if o != c for i in places]
    drawn = [_drawn_line(fixed + sums.get(k, 0), design.response[c], xs, np.random.default_rng(seed + 104729 * k)) for k in range(1, m + 1)]
    terms, middle = [design.terms[i] for i in xs], center[xs]
    fitted, other = (_line([d[kind] for d in drawn], terms, middle) for kind in (0, 1))
    tie = lambda copy: F.xxhash64(F.col(id_col), copy, F.lit(seed))
    turn = F.pmod(F.xxhash64(F.col(id_col), F.col("__copy"), F.lit(seed + 1)), F.lit(1 << 20))
    rows = state.select(
        *state.columns, F.when(F.col(gone), other).otherwise(fitted).alias("__hat"), tie(F.col("__copy")).alias("__tie"), turn.alias("__turn"), F.lit(True).alias("__own"), (~F.col(gone)).alias("__known"))
    each = range(1, m + 1)
    more = whole.select(
        F.array(*[_line([d[0] for d in drawn], terms, middle, k) for k in each]).alias("__hats"), F.array(*[tie(F.lit(k)) for k in each]).alias("__ties"), c)
    return stored(nearest_match(rows, c, donors, parts, more, CUT_ROWS).select(*state.columns))


def _copies(rows: DataFrame, m: int) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(m))).alias("__copy"))


def impute_mice_pmm(df: DataFrame, id_col: str, cols: Sequence[str], m: int = 5, maxit: int = 5, seed: int = 1,
                    donors: int = 5) -> DataFrame:
    """Chained equations with predictive mean matching; a column `imp` numbers the completed copies.

    All copies go through the rounds together. A step writes the rows with holes alone; what the rows without any add to
    the regressions is summed once. Ids are unique.
    """
    gone = {c: f"__gone_{c}" for c in cols}
    # every step reads this table, so it is spread evenly once
    base = stored(df.select(id_col, *cols, *[F.col(c).isNull().alias(g) for c, g in gone.items()]).repartition(shuffle_partitions(df), id_col))
    cols, incomplete, levels = _columns(base, cols)
    holed = reduce(lambda a, b: a | b, [F.col(gone[c]) for c in incomplete], F.lit(False))
    whole, state = base.filter(~holed), _copies(base.filter(holed), m)
    if incomplete:
        hot = hot_groups(base, [])
        for i, c in enumerate(incomplete):
            start = _draw(base.filter(F.col(c).isNotNull()), state.filter(F.col(c).isNull()), id_col, c, seed + i, hot)
            state = state.join(start.withColumnRenamed(c, "__new"), [id_col, "__copy"], "left").withColumn(c, F.coalesce(c, "__new")).drop("__new")
        state = stored(state)
        design = _Design.of_columns(cols, levels)
        middle = base.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(design.terms)]).first()
        center = np.array([v or 0.0 for v in middle], float)
        fixed = cross_products(whole, design.terms, center).get(0, np.zeros((len(center) + 1,) * 2))
        parts = base.count() // PART_ROWS + 1
        for turn in range(maxit):
            for i, c in enumerate(incomplete):
                state = _pmm_step(state, whole, c, design, fixed, center, m, donors, parts, seed + 1299709 * turn + i, id_col)
    out = _copies(whole, m).unionByName(state).drop(*gone.values())
    rest = [c for c in df.columns if c not in base.columns]
    out = out.join(df.select(id_col, *rest), id_col) if rest else out
    return out.select(*df.columns, F.col("__copy").alias("imp"))


def impute_mice_rf(df: DataFrame, id_col: str, cols: Sequence[str], m: int = 1, maxit: int = 30, seed: int = 999,
                   trees: int = 10, depth: int = 5) -> DataFrame:
    """Chained equations with random forests: donors come from the leaves a row falls into (see `forest`). Ids are unique."""
    base = stable(df.select(id_col, *cols))
    cols, incomplete, levels = _columns(base, cols)
    copies = []
    for k in range(1, m + 1):
        done = df
        if incomplete:
            filled = impute_forest(base, id_col, cols, incomplete, levels, maxit, seed + 7919 * (k - 1), trees, depth)
            done = df.drop(*incomplete).join(filled, id_col)
        copies.append(done.select(*df.columns).withColumn("imp", F.lit(k)))
    return reduce(DataFrame.unionByName, copies)
