"""Cross-tabs, summary tables, and how their cells are written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.operators.shape import union_all
from hearthline.operators.skew import group_quantiles, same_key_join
from hearthline.operators.stats import chisq_from_counts, chisq_test

TOTAL = "Total"
UNKNOWN = "Unknown"

# --- formats --------------------------------------------------------------------------------


def percent_format(share: Column) -> Column:
    """10 % and more without, less with one decimal."""
    pct = share * 100
    return (
        F.when(share.isNull(), None)
        .when(pct >= 10, F.format_string("%d", F.round(pct).cast("long")))
        .when((pct > 0) & (pct < 0.1), F.lit("<0.1"))
        .when(pct == 0, F.lit("0"))
        .otherwise(F.format_string("%.1f", F.round(pct, 1)))
    )


def p_format(p: Column) -> Column:
    """One decimal from 0.2, two from 0.1, three below; the far ends as a bound."""
    shown = lambda d: F.format_string(f"%.{d}f", F.round(p, d))
    return (
        F.when(p.isNull(), None)
        .when(p > 0.9, F.lit(">0.9"))
        .when(p < 0.001, F.lit("<0.001"))
        .when(F.round(p, 1) >= 0.2, shown(1))
        .when(F.round(p, 2) >= 0.1, shown(2))
        .otherwise(shown(3))
    )


def count_format(n: Column) -> Column:
    return F.format_number(n, 0)


# --- cross-tab ------------------------------------------------------------------------------


def _counted(df: DataFrame, row: str, col: str, missing: str) -> DataFrame:
    label = lambda x: F.col(x).cast("string")
    pairs = df.select(label(row).alias("row"), label(col).alias("col"))
    if missing == "ifany":
        pairs = pairs.na.fill(UNKNOWN)
    else:
        pairs = pairs.na.drop("any")
    return pairs.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


def cross_tab(df: DataFrame, row: str, col: str, percent: str = "row", missing: str = "ifany") -> DataFrame:
    """Tidy cross-tab with margins: (row, col, n, share, text); missing values form a level if any.

    The data is counted once per pair of levels; margins are built from those counts. Pairs
    without rows are not listed here; `cross_tab_wide` shows them as 0.
    """
    cells = (
        _counted(df, row, col, missing)
        .cube("row", "col")
        .agg(F.sum("n").alias("n"), F.grouping("row").alias("all_rows"), F.grouping("col").alias("all_cols"))
        .select(
            F.when(F.col("all_rows") == 1, F.lit(TOTAL)).otherwise(F.col("row")).alias("row"),
            F.when(F.col("all_cols") == 1, F.lit(TOTAL)).otherwise(F.col("col")).alias("col"),
            "n", "all_rows", "all_cols",
        )
    )
    if percent == "cell":
        base = cells.filter((F.col("all_rows") == 1) & (F.col("all_cols") == 1)).select("n").scalar()
        shares = cells.withColumn("share", F.col("n") / base)
    else:
        side, margin = ("row", "all_cols") if percent == "row" else ("col", "all_rows")
        bases = cells.filter(F.col(margin) == 1).select(side, F.col("n").alias("base"))
        shares = cells.join(bases, side).withColumn("share", F.col("n") / F.col("base"))
    return shares.select("row", "col", "n", "share", _cell(F.col("n"), F.col("share")).alias("text"))


def _cell(n: Column, share: Column) -> Column:
    return F.concat(count_format(n), F.lit(" ("), percent_format(share), F.lit("%)"))


def cross_tab_p(df: DataFrame, row: str, col: str, missing: str = "ifany") -> DataFrame:
    """Test behind a cross-tab: χ², or the exact test where a count below 5 is expected. `test` names the one whose p it is;
    a table too large for the exact test keeps that of χ², marked as `chi-squared, small counts`. A single line has no test."""
    test = chisq_from_counts(_counted(df, row, col, missing), "row", "col")
    p = F.coalesce("p_exact", "p")
    kind = (F.when(p.isNull(), None).when(F.col("p_exact").isNotNull(), "exact").when(F.col("min_expected") < 5, "chi-squared, small counts")
            .otherwise("chi-squared"))
    return test.select("statistic", "df", "n", "min_expected", p.alias("p"), p_format(p).alias("p_text"), kind.alias("test"))


def cross_tab_wide(df: DataFrame, row: str, col: str, levels: Sequence[str], percent: str = "row",
                   missing: str = "ifany") -> DataFrame:
    """The report: a head line with the p-value, one line per row level, a total line."""
    tidy = cross_tab(df, row, col, percent, missing)
    wide = tidy.groupBy("row").pivot("col", [*levels, TOTAL]).agg(F.first("text")).na.fill("0 (0%)")
    names = ["characteristic", *levels, TOTAL]
    lines = wide.select(
        F.col("row").alias("characteristic"), *[F.col(c) for c in [*levels, TOTAL]], F.lit(None).cast("string").alias("p_value"),
        F.when(F.col("row") == TOTAL, 2).otherwise(1).alias("__place"))
    head = cross_tab_p(df, row, col, missing).select(
        F.lit(row).alias("characteristic"), *[F.lit(None).cast("string").alias(c) for c in names[1:]],
        F.col("p_text").alias("p_value"), F.lit(0).alias("__place"))
    return head.unionByName(lines).orderBy("__place", "characteristic").drop("__place")


def at_risk(df: DataFrame, level: str, left: Sequence[str] = ("dropout",)) -> DataFrame:
    """Those who reached `level`: its value is known and none of those that mean having left before."""
    return df.filter(F.col(level).isNotNull() & ~F.col(level).cast("string").isin(list(left)))


def transition_tables(df: DataFrame, variables: Sequence[str], percent: str = "row", left: Sequence[str] = ("dropout",)) -> DataFrame:
    """Cross-tabs of each level with the next one among those at risk, stacked: (step, row, col, n, share, text)."""
    steps = [
        cross_tab(at_risk(df, a, left), a, b, percent).select(F.lit(f"{a} -> {b}").alias("step"), "*")
        for a, b in zip(variables, variables[1:])
    ]
    return union_all(*steps)


def transition_tests(df: DataFrame, variables: Sequence[str], left: Sequence[str] = ("dropout",)) -> DataFrame:
    """The χ² test of each of these tables: (step, statistic, df, n, min_expected, p, p_exact)."""
    steps = [
        chisq_test(at_risk(df, a, left), a, b, correct=False).select(F.lit(f"{a} -> {b}").alias("step"), "*")
        for a, b in zip(variables, variables[1:])
    ]
    return union_all(*steps)


# --- summaries ------------------------------------------------------------------------------


def numeric_summary(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per column (and group): n, mean, sd, min, q25, median, q75, max; two passes for all columns."""
    keys = list(keys)
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, list(cols), "variable", "value")
    moments = long.groupBy(*keys, "variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    cuts = group_quantiles(long, [*keys, "variable"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return same_key_join(moments, cuts, [*keys, "variable"], "left")


def level_counts(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per column (and group) and level: n, N of known values, share. Missing values are not shown."""
    keys = list(keys)
    long = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(keys, list(cols), "variable", "level")
    counts = long.filter(F.col("level").isNotNull()).groupBy(*keys, "variable", "level").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys, "variable").agg(F.sum("n").alias("total"))
    joined = same_key_join(counts, totals, [*keys, "variable"], "inner")
    return joined.withColumn("share", F.col("n") / F.col("total"))


def column_types(df: DataFrame) -> dict[str, str]:
    """continuous, dichotomous or categorical by type."""
    kinds = {}
    for f in df.schema:
        if isinstance(f.dataType, T.BooleanType):
            kinds[f.name] = "dichotomous"
        elif isinstance(f.dataType, T.NumericType):
            kinds[f.name] = "continuous"
        elif isinstance(f.dataType, T.StringType):
            kinds[f.name] = "categorical"
    return kinds


def summary_table(df: DataFrame, types: Mapping[str, str] | None = None, keys: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """(variable, label, stat): mean (sd) and min,median,max; n / N (p%); n (p%) of the true ones."""
    kinds = dict(types or {n: k for n, k in column_types(df).items() if n not in keys})
    of = lambda kind: [n for n, k in kinds.items() if k == kind]
    keys, parts = list(keys), []
    number = lambda c: F.format_string(f"%,.{digits}f", F.round(F.col(c), digits))
    if of("continuous"):
        s = numeric_summary(df, of("continuous"), keys)
        mean_sd = F.concat(number("mean"), F.lit(" ("), number("sd"), F.lit(")"))
        spread = F.concat_ws(",", number("min"), number("median"), number("max"))
        both = F.array(*[F.struct(F.lit(label).alias("label"), text.alias("stat")) for label, text in (("Mean (SD)", mean_sd), ("Minimum,Median,Maximum", spread))])
        parts.append(s.select(*keys, "variable", F.inline(both)))
    if of("categorical"):
        s = level_counts(df, of("categorical"), keys)
        text = F.concat(count_format(F.col("n")), F.lit(" / "), count_format(F.col("total")), F.lit(" ("),
                        percent_format(F.col("share")), F.lit("%)"))
        parts.append(s.select(*keys, "variable", F.col("level").alias("label"), text.alias("stat")))
    if of("dichotomous"):
        flags = df.select(*keys, *[F.col(c).cast("int").alias(c) for c in of("dichotomous")])
        long = flags.unpivot(keys, of("dichotomous"), "variable", "flag")
        s = long.groupBy(*keys, "variable").agg(F.coalesce(F.sum("flag"), F.lit(0)).alias("n"), F.avg("flag").alias("share"))
        parts.append(s.select(*keys, "variable", F.lit("").alias("label"), _cell(F.col("n"), F.col("share")).alias("stat")))
    return union_all(*parts)


def summary_by_strata(df: DataFrame, strata: str, levels: Sequence[str], types: Mapping[str, str] | None = None) -> DataFrame:
    """The summary of all rows and of each stratum side by side. Each row stands in its stratum and in the whole, so one
    grouped summary gives both."""
    kinds = types or {n: k for n, k in column_types(df).items() if n != strata}
    marks = F.array(F.lit("all"), F.concat(F.lit("of "), F.col(strata)))
    rows = df.select(*kinds, F.explode(marks).alias("__mark")).filter(F.col("__mark").isNotNull())
    names = {"all": "overall"} | {f"of {lv}": lv for lv in levels}
    wide = summary_table(rows, kinds, ["__mark"]).groupBy("variable", "label").pivot("__mark", list(names)).agg(F.first("stat"))
    return wide.filter(F.col("all").isNotNull()).select("variable", "label", *[F.col(k).alias(v) for k, v in names.items()])


def distribution_table(df: DataFrame, key: str, x: str) -> DataFrame:
    """n, mean, sd and quartiles of `x` per group."""
    s = numeric_summary(df, [x], [key])
    return s.select(key, "n", "mean", "sd", "q25", F.col("median").alias("q50"), "q75")


def describe(df: DataFrame, numeric: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Long summary (variable, stat, value): moments and quartiles of numbers, counts of levels."""
    parts = []
    if numeric:
        s = numeric_summary(df, numeric)
        stats = [c for c in s.columns if c != "variable"]
        parts.append(s.withColumns({c: F.col(c).cast("double") for c in stats}).unpivot(["variable"], stats, "stat", "value"))
    if labels:
        counts = level_counts(df, labels)
        parts.append(counts.select("variable", F.concat(F.lit("n:"), "level").alias("stat"), F.col("n").cast("double").alias("value")))
    return union_all(*parts)
