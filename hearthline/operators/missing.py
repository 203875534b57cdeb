"""What is missing, in which patterns, and whether it matters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.functions.tails import chi2_sf
from hearthline.operators.shape import union_all
from hearthline.operators.stats import anova_f, chisq_test
from hearthline.operators.tables import level_counts, numeric_summary
from hearthline.session import stable


def missing_glimpse(df: DataFrame) -> DataFrame:
    """(variable, type, n, missing_n, missing_percent) of every column in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("__all"), *[F.count(c).alias(c) for c in df.columns])
    rows = F.array(*[
        F.struct(F.lit(f.name).alias("variable"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.col(f.name).alias("n"), (F.col("__all") - F.col(f.name)).alias("missing_n"))
        for f in df.schema
    ])
    total = F.col("n") + F.col("missing_n")
    return counts.select(F.inline(rows)).withColumn(
        "missing_percent", F.when(total > 0, 100 * F.col("missing_n") / total))


def full_glimpse(df: DataFrame) -> DataFrame:
    """The glimpse with mean, sd and quartiles of numbers and the number of levels of labels."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    labels = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    out = missing_glimpse(df)
    if numeric:
        out = out.join(numeric_summary(df, numeric).drop("n"), "variable", "left")
    if labels:
        levels = level_counts(df, labels).groupBy("variable").agg(F.count(F.lit(1)).alias("n_levels"))
        out = out.join(levels, "variable", "left")
    return out


def missing_pattern(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct patterns (1 present, 0 missing) with their count and number of missing columns."""
    flags = [F.col(c).isNotNull().cast("int").alias(c) for c in cols]
    counts = df.select(*flags).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    gone = sum((1 - F.col(c) for c in cols), F.lit(0))
    return counts.withColumn("n_missing", gone)


def missing_pattern_totals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing values per column: the bottom line of the pattern table."""
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])


def missing_compare(df: DataFrame, dependent: str, explanatory: Sequence[str]) -> DataFrame:
    """Does each explanatory column differ between rows with and without `dependent`?

    Numbers by a comparison of means, labels by χ²: (variable, test, statistic, p).
    """
    marked = df.withColumn("__gone", F.col(dependent).isNull().cast("string"))
    parts = []
    for name in explanatory:
        if isinstance(df.schema[name].dataType, T.NumericType):
            test, kind = anova_f(marked, name, "__gone"), "F"
        else:
            test, kind = chisq_test(marked, name, "__gone", correct=True), "chisq"
        parts.append(test.select(F.lit(name).alias("variable"), F.lit(kind).alias("test"), "statistic", "p"))
    return union_all(*parts)


COLLECTED = 4096  # patterns of p² sums that the driver works through itself; more stay in Spark


def _e_step(pattern: tuple[int, list[int], np.ndarray, np.ndarray], mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Expected sums and cross-products of the rows of one missing pattern, as one flat block."""
    n, seen, sums, cross = pattern
    p = len(mu)
    gone = [i for i in range(p) if i not in seen]
    first, second = np.zeros(p), np.zeros((p, p))
    o = np.ix_(seen, seen)
    first[seen], second[o] = sums[seen], cross[o]
    if gone:
        b = sigma[np.ix_(gone, seen)] @ np.linalg.inv(sigma[o])
        a = mu[gone] - b @ mu[seen]
        first[gone] = n * a + b @ sums[seen]
        mixed = np.outer(a, sums[seen]) + b @ cross[o]
        second[np.ix_(gone, seen)], second[np.ix_(seen, gone)] = mixed, mixed.T
        rest, inner = sigma[np.ix_(gone, gone)] - b @ sigma[np.ix_(seen, gone)], b @ sums[seen]
        second[np.ix_(gone, gone)] = n * rest + n * np.outer(a, a) + np.outer(a, inner) + np.outer(inner, a) + b @ cross[o] @ b.T
    return np.concatenate([first, second.ravel()])


def _distance(pattern: tuple[int, list[int], np.ndarray, np.ndarray], mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """A pattern's share of the statistic, and how many columns it has seen."""
    n, seen, sums, _ = pattern
    gap = sums[seen] / n - mu[seen]
    return np.array([n * gap @ np.linalg.inv(sigma[np.ix_(seen, seen)]) @ gap, len(seen), 1.0])


def mcar_test(df: DataFrame, cols: Sequence[str], max_iter: int = 200, tol: float = 1e-8) -> DataFrame:
    """Little's (1988) test that values are missing completely at random: (statistic, df, p, patterns, converged).

    Spark reduces the data to counts, sums and cross-products per missing pattern that occurs. The normal model's mean and
    covariance are then found by EM: each round adds up a block of p + p² numbers over the patterns, on the driver while these are
    few, else in Spark; the sums are the same.
    """
    p = len(cols)
    x = [F.col(c).cast("double") for c in cols]
    center = df.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(x)],
                    *[F.stddev_samp(e).alias(f"s{i}") for i, e in enumerate(x)]).first()
    z = [(e - F.lit(center[f"m{i}"])) / F.lit(center[f"s{i}"] or 1.0) for i, e in enumerate(x)]
    zero = [F.coalesce(e, F.lit(0.0)) for e in z]
    flat = df.select(F.array(*[e.isNotNull() for e in x]).alias("seen"), *[e.alias(f"z{i}") for i, e in enumerate(zero)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    patterns = flat.groupBy("seen").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f"z{i}") for i in range(p)]).alias("t"),
        F.array(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs]).alias("c")).filter(F.array_contains("seen", True))
    patterns = stable(patterns)

    def read(r) -> tuple[int, list[int], np.ndarray, np.ndarray]:
        cross = np.zeros((p, p))
        for v, (i, j) in zip(r.c, pairs):
            cross[i, j] = cross[j, i] = v
        return r.n, [i for i, s in enumerate(r.seen) if s], np.array(r.t, float), cross

    few = patterns.limit(COLLECTED + 1).collect()
    held = [read(r) for r in few] if len(few) <= COLLECTED else None

    def total(step, size: int, mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
        if held is not None:
            return sum((step(h, mu, sigma) for h in held), np.zeros(size))

        def part(batches):
            mine = np.zeros(size)
            for pdf in batches:
                for r in pdf.itertuples():
                    mine += step(read(r), mu, sigma)
            yield pd.DataFrame({"k": np.arange(size, dtype="int32"), "v": mine})

        sums = patterns.mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        return np.array([r.v for r in sums])

    rows = patterns.agg(F.sum("n")).first()[0] or 0
    mu, sigma, converged = np.zeros(p), np.eye(p), False
    for _ in range(max_iter if rows else 0):
        sums = total(_e_step, p + p * p, mu, sigma) / rows
        new_mu = sums[:p]
        new_sigma = sums[p:].reshape(p, p) - np.outer(new_mu, new_mu)
        change = max(np.abs(new_mu - mu).max(), np.abs(new_sigma - sigma).max())
        mu, sigma = new_mu, new_sigma
        if change < tol:
            converged = True
            break
    statistic, seen, kinds = total(_distance, 3, mu, sigma * rows / max(rows - 1, 1)) if rows else (0.0, 0.0, 0.0)
    freedom = int(seen) - p
    p_value = chi2_sf(float(statistic), freedom) if freedom > 0 else None
    return df.sparkSession.createDataFrame(
        [(float(statistic), freedom, p_value, int(kinds), converged)], "statistic double, df int, p double, patterns int, converged boolean")
