"""Tests and correlations from grouped counts and moments: one pass, then a row or a few."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from hearthline.functions import tails
from hearthline.operators.skew import hot_groups, running_total


def chisq_from_counts(counts: DataFrame, a: str, b: str, n: str = "n", correct: bool = False) -> DataFrame:
    """χ² of a table of counts: statistic, df, n, min_expected, p and, where a count below 5 is expected, the exact p.

    Cells without rows need not be listed. Windows run over the counts, not over the data. The exact p is missing for tables
    of more than `EXACT_CELLS` filled cells or of too many ways to fill them (`tails.exact_table_p`): there χ² stands alone.
    """
    by_a, by_b = Window.partitionBy(a), Window.partitionBy(b)
    cells = counts.filter(F.col(n) > 0).select(
        F.col(n).cast("double").alias("o"),
        F.sum(n).over(by_a).cast("double").alias("r"), F.count(F.lit(1)).over(by_a).alias("in_r"),
        F.sum(n).over(by_b).cast("double").alias("c"), F.count(F.lit(1)).over(by_b).alias("in_c"),
    )
    sums = cells.agg(
        F.sum("o").alias("total"), F.sum(F.col("o") ** 2 / (F.col("r") * F.col("c"))).alias("s"),
        F.round(F.sum(1 / F.col("in_r"))).alias("rows"), F.round(F.sum(1 / F.col("in_c"))).alias("cols"),
        F.sum(1 / (F.col("r") * F.col("in_r"))).alias("inv_r"), F.sum(1 / (F.col("c") * F.col("in_c"))).alias("inv_c"),
        F.min("r").alias("min_r"), F.min("c").alias("min_c"), F.max(F.struct("o", "r", "c")).alias("one"),
    )
    total, one = F.col("total"), F.col("one")
    df = (F.col("rows") - 1) * (F.col("cols") - 1)
    statistic = total * (F.col("s") - 1)
    square = (F.col("rows") == 2) & (F.col("cols") == 2)
    if correct:  # in a 2×2 table all four deviations have the same size
        gap = F.abs(one["o"] - one["r"] * one["c"] / total)
        corrected = (gap - F.least(F.lit(0.5), gap)) ** 2 * total * F.col("inv_r") * F.col("inv_c")
        statistic = F.when(square, corrected).otherwise(statistic)
    out = sums.select(
        F.greatest(statistic, F.lit(0.0)).alias("statistic"), df.alias("df"), total.cast("long").alias("n"),
        (F.col("min_r") * F.col("min_c") / total).alias("min_expected"),
        F.when(square & (F.col("min_r") * F.col("min_c") / total < 5), one).alias("one"),
    )
    exact = tails.exact_2x2_p_col(F.col("one.o"), F.col("one.r"), F.col("one.c"), F.col("n"))
    known = F.when(F.col("df") > 0, F.col("df"))
    tests = out.select(
        "statistic", "df", "n", "min_expected", tails.chi2_p_col(F.col("statistic"), known).alias("p"), exact.alias("p_exact")
    )
    return _with_exact_table(tests, counts, a, b, n)


EXACT_CELLS = 100  # filled cells up to which a table is gathered into one row for the exact test


def _with_exact_table(tests: DataFrame, counts: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """Fills `p_exact` of tables larger than 2×2 with a small expected count; no more than EXACT_CELLS cells meet in a row."""
    filled = counts.filter(F.col(n) > 0)
    few = filled.agg(F.count(F.lit(1)).alias("n")).scalar() <= EXACT_CELLS
    cells = filled.filter(few).agg(F.collect_list(F.struct(
        F.col(a).cast("string").alias("i"), F.col(b).cast("string").alias("j"), F.col(n).cast("long").alias("n"))).alias("cells"))
    both = tests.join(F.broadcast(cells), F.lit(True))  # one row each
    wanted = F.col("p_exact").isNull() & (F.col("df") > 1) & (F.col("min_expected") < 5) & (F.size("cells") > 0)
    exact = tails.exact_table_p_col(F.when(wanted, F.col("cells")))
    return both.select(*[c for c in tests.columns if c != "p_exact"], F.coalesce("p_exact", exact).alias("p_exact"))


def chisq_test(df: DataFrame, a: str, b: str, correct: bool = True) -> DataFrame:
    """Contingency test of two columns; rows with a missing value are left out."""
    counts = df.select(a, b).na.drop("any").groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return chisq_from_counts(counts, a, b, "n", correct)


def _moments(df: DataFrame, x: str, group: str) -> DataFrame:
    return df.select(group, F.col(x).cast("double").alias("__x")).na.drop("any").groupBy(group).agg(
        F.count("__x").alias("n"), F.avg("__x").alias("m"), F.var_samp("__x").alias("v"))


def t_test(df: DataFrame, x: str, group: str) -> DataFrame:
    """Welch's test between the two levels of `group` (in their order): first minus second. Any other number of levels is an error."""
    both = _moments(df, x, group).agg(
        F.min_by(F.struct("n", "m", "v"), group).alias("a"), F.max_by(F.struct("n", "m", "v"), group).alias("b"), F.count(F.lit(1)).alias("levels"))
    wrong = F.raise_error(F.concat(F.lit("a t test needs two levels, not "), F.col("levels").cast("string"))).cast("double")
    se_a, se_b = F.col("a.v") / F.col("a.n"), F.col("b.v") / F.col("b.n")
    freedom = (se_a + se_b) ** 2 / (se_a**2 / (F.col("a.n") - 1) + se_b**2 / (F.col("b.n") - 1))
    out = both.select(
        F.when(F.col("levels") == 2, F.col("a.m")).otherwise(wrong).alias("mean_a"), F.col("b.m").alias("mean_b"),
        ((F.col("a.m") - F.col("b.m")) / F.sqrt(se_a + se_b)).alias("statistic"), freedom.alias("df"))
    return out.withColumn("p", tails.t_p_col(F.col("statistic"), F.col("df")))


def anova_f(df: DataFrame, x: str, group: str) -> DataFrame:
    """One-way comparison of means. Group means are centred at the grand mean before they are squared."""
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    moments = _moments(df, x, group)
    grand = moments.agg((F.sum(n * m) / F.sum(n)).alias("grand"))
    sums = moments.join(F.broadcast(grand), F.lit(True)).agg(  # one row
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum(n * (m - F.col("grand")) ** 2).alias("between"),
        F.sum((n - 1) * F.coalesce(v, F.lit(0.0))).alias("within"))
    df1, df2 = F.col("k") - 1, F.col("total") - F.col("k")
    between = F.col("between")
    safe = (df1 > 0) & (df2 > 0) & (F.col("within") > 0)
    out = sums.select(F.when(safe, (between / df1) / (F.col("within") / df2)).alias("statistic"),
                      df1.alias("df1"), df2.alias("df2"))
    return out.withColumn("p", tails.f_p_col(F.col("statistic"), F.col("df1"), F.col("df2")))


def average_ranks(df: DataFrame, x: str, out: str, hot: list[Row] | None = None) -> DataFrame:
    """(value, rank) with ties sharing their mean rank; sorted are the distinct values only."""
    counts = df.groupBy(F.col(x)).agg(F.count(F.lit(1)).alias("__c"))
    reached = running_total(counts, [], [F.col(x).asc()], "__cum", F.col("__c"), hot=hot)
    return reached.select(x, (F.col("__cum") - (F.col("__c") - 1) / 2).alias(out))


def cor_spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation on complete pairs."""
    pairs = df.select(x, y).na.drop("any").groupBy(x, y).agg(F.count(F.lit(1)).alias("__w"))
    rows = df.select(x, y).na.drop("any")
    # the rank tables are not split by value, so both sides are shuffled and adaptive execution can
    # split a value with many partners, or broadcast a short table
    hot = hot_groups(rows, [])
    ranked = pairs.join(average_ranks(rows, x, "__rx", hot), x).join(average_ranks(rows, y, "__ry", hot), y)
    w, a, b = F.col("__w").cast("double"), F.col("__rx").cast("double"), F.col("__ry").cast("double")
    s = ranked.agg(*[F.sum(e).alias(k) for k, e in {
        "w": w, "a": w * a, "b": w * b, "aa": w * a * a, "bb": w * b * b, "ab": w * a * b}.items()])
    cov = F.col("ab") - F.col("a") * F.col("b") / F.col("w")
    va, vb = F.col("aa") - F.col("a") ** 2 / F.col("w"), F.col("bb") - F.col("b") ** 2 / F.col("w")
    return s.select(F.col("w").cast("long").alias("n"), (cov / F.sqrt(va * vb)).alias("rho"))


def cor_pearson(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation on rows with both values, per group if wanted."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
