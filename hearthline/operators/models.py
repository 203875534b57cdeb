"""Regressions: formulas, linear, logistic, censored and one-latent models, and their tables.

The data stays in Spark: `pyspark.ml` or summed moments and derivatives do the passes, and only
matrices of the number of terms reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.functions import tails
from hearthline.functions.recode import r_ifelse
from hearthline.operators.shape import union_all

INTERCEPT = "(Intercept)"

# --- formulas and design --------------------------------------------------------------------


@dataclass(frozen=True)
class Formula:
    """Response and terms; a term is a column or an interaction "a:b"."""

    response: str
    terms: tuple[str, ...]

    def add(self, *terms: str) -> Formula:
        return replace(self, terms=self.terms + tuple(t for t in terms if t not in self.terms))

    def drop(self, *terms: str) -> Formula:
        return replace(self, terms=tuple(t for t in self.terms if t not in terms))

    def explain(self, response: str) -> Formula:
        return replace(self, response=response)

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([self.response, *(c for t in self.terms for c in t.split(":"))]))

    def __str__(self) -> str:
        return f"{self.response} ~ {' + '.join(self.terms)}"


def formula_builder(response: str, terms: Sequence[str]) -> Formula:
    return Formula(response, tuple(terms))


def with_outcome(df: DataFrame, condition: Column, name: str = "outcome") -> DataFrame:
    """A logical response as 0/1, missing where the condition is."""
    return df.withColumn(name, condition.cast("double"))


def factor_levels(df: DataFrame, name: str) -> list[str]:
    """Sorted levels of a label column. Each but the first is a term of the model, whose matrices the driver holds."""
    seen = df.select(F.col(name).cast("string").alias("l")).filter(F.col("l").isNotNull()).distinct()
    return sorted(r.l for r in seen.collect())


def coded(df: DataFrame, formula: Formula) -> tuple[DataFrame, list[str]]:
    """Complete rows as numbers, `label` and x0, x1, ..; labels are coded against their first level."""
    rows = df.select(*formula.columns).na.drop("any")
    codes: dict[str, list[tuple[str, Column]]] = {}
    for name in formula.columns[1:]:
        kind = df.schema[name].dataType
        if isinstance(kind, T.BooleanType):
            codes[name] = [(f"{name}TRUE", F.col(name).cast("double"))]
        elif isinstance(kind, T.StringType):
            codes[name] = [(name + lv, (F.col(name) == lv).cast("double")) for lv in factor_levels(rows, name)[1:]]
        else:
            codes[name] = [(name, F.col(name).cast("double"))]
    columns: list[tuple[str, Column]] = []
    for term in formula.terms:
        made = [("", F.lit(1.0))]
        for part in term.split(":"):
            made = [(f"{a}:{b}".lstrip(":"), x * y) for a, x in made for b, y in codes[part]]
        columns += made
    named = rows.select(
        F.col(formula.response).cast("double").alias("label"), *[c.alias(f"x{i}") for i, (_, c) in enumerate(columns)])
    return named, [n for n, _ in columns]


def design(df: DataFrame, formula: Formula) -> tuple[DataFrame, list[str]]:
    """Complete rows with `label` and a `features` vector."""
    rows, names = coded(df, formula)
    inputs = [f"x{i}" for i in range(len(names))]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(rows), names


# --- fits -----------------------------------------------------------------------------------


@dataclass
class Fit:
    """Estimates by term (intercept first) and what is known about the whole fit."""

    name: str
    formula: Formula
    terms: list[str]
    estimate: list[float]
    se: list[float | None]
    stats: dict[str, float] = field(default_factory=dict)

    @property
    def df(self) -> float | None:
        return self.stats.get("df_residual")

    def tidy(self, spark: SparkSession) -> DataFrame:
        rows = []
        for term, b, se in zip(self.terms, self.estimate, self.se):
            stat = float(b / se) if se else None
            p = None if stat is None else tails.t_p(stat, self.df) if self.df else tails.normal_p(stat)
            rows.append((self.name, term, None if b is None else float(b), None if se is None else float(se), stat, p))
        return spark.createDataFrame(
            rows, "model string, term string, estimate double, se double, statistic double, p double")

    def glance(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, k, float(v)) for k, v in self.stats.items() if v is not None]
        return spark.createDataFrame(rows, "model string, stat string, value double")


def _kept(rows: DataFrame) -> DataFrame:
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def ols(formula: Formula, df: DataFrame, name: str = "ols") -> Fit:
    """Linear model from summed products, with any number of terms; a term that the terms before it already
    determine has no estimate."""
    columns, names = coded(df, formula)
    n, means, s = moment_matrix(columns, columns.columns)
    k = len(names)
    used: list[int] = []
    for i in range(1, k + 1):  # keep a term only if it adds something
        rest = s[i, i]
        if used:
            rest -= s[i, used] @ np.linalg.solve(s[np.ix_(used, used)], s[used, i])
        if rest > 1e-9 * s[i, i]:
            used.append(i)
    sxx, sxy = s[np.ix_(used, used)], s[used, 0]
    b = np.linalg.solve(sxx, sxy) if used else np.zeros(0)
    rss, freedom = n * max(s[0, 0] - b @ sxy, 0.0), n - len(used) - 1
    sigma2 = rss / freedom if freedom > 0 else math.nan
    inverse = np.linalg.inv(sxx * n) if used else np.zeros((0, 0))
    mean_x = means[used]
    estimate: list = [means[0] - b @ mean_x, *[None] * k]
    errors: list = [math.sqrt(sigma2 * (1 / n + mean_x @ inverse @ mean_x)), *[None] * k]
    for place, i in enumerate(used):
        estimate[i], errors[i] = b[place], math.sqrt(sigma2 * inverse[place, place])
    r2 = 1 - rss / (n * s[0, 0]) if s[0, 0] > 0 else None
    stats = {"n": n, "r2": r2, "adj_r2": None if r2 is None or freedom <= 0 else 1 - (1 - r2) * (n - 1) / freedom,
             "df_residual": freedom, "sigma": math.sqrt(sigma2)}
    return Fit(name, formula, [INTERCEPT, *names], estimate, errors, stats)


def logit(formula: Formula, df: DataFrame, name: str = "logit") -> Fit:
    rows, names = design(df, formula)
    rows = _kept(rows)  # read once per Newton step
    try:
        model = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=50, tol=1e-10).fit(rows)
        s = model.summary
        errors = list(s.coefficientStandardErrors)
        stats = {"n": s.numInstances, "converged": float(s.numIterations < 50), "aic": s.aic, "deviance": s.deviance, "null_deviance": s.nullDeviance}
    finally:
        rows.unpersist()
    return Fit(name, formula, [INTERCEPT, *names], [model.intercept, *model.coefficients], [errors[-1], *errors[:-1]], stats)


def _code_parts(rows: DataFrame, name: str, outcomes: Sequence[str]) -> tuple[list[tuple[str, Column]], dict[str, list[str]]]:
    """All number columns that a predictor may stand for, and which of them each model's rows ask for."""
    kind = rows.schema[name].dataType
    if not isinstance(kind, T.StringType):
        label = f"{name}TRUE" if isinstance(kind, T.BooleanType) else name
        return [(label, F.col(name).cast("double"))], {o: [label] for o in outcomes}
    seen = rows.groupBy(F.col(name).alias("l")).agg(*[F.count(o).alias(o) for o in outcomes]).collect()  # the levels are terms
    levels = sorted(r["l"] for r in seen)
    held = {o: sorted(r["l"] for r in seen if r[o])[1:] for o in outcomes}
    return [(name + v, (F.col(name) == v).cast("double")) for v in levels], {o: [name + v for v in held[o]] for o in outcomes}


def _products(terms: Sequence[str], parts: Mapping[str, Sequence]) -> list:
    """Names (or names with columns) of the terms, an interaction being all products of its parts."""
    made = []
    for term in terms:
        own = [("", F.lit(1.0))]
        for part in term.split(":"):
            own = [(f"{a}:{b}".lstrip(":"), x * y) for a, x in own for b, y in parts[part]]
        made += own
    return made


def _logit_sums(rows: DataFrame, betas: Mapping[int, np.ndarray], used: Mapping[int, Sequence[int]]) -> dict[int, tuple]:
    """{model: (n, log-likelihood, gradient, information)} in one pass for all models still open; x has the intercept first."""

    def part(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            wide = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(size, -1)
            every_x, every_y = np.column_stack([np.ones(size), wide("x")]), wide("y")
            every_w = batch.column("w").to_numpy(zero_copy_only=False)
            for m, beta in betas.items():
                at = every_y[:, m] >= 0
                if not at.any():
                    continue
                x, y, w = every_x[at][:, used[m]], every_y[at, m], every_w[at]
                eta = x @ beta
                mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                ll = (w * (y * eta - np.logaddexp(0, eta))).sum()
                block = np.concatenate([[w.sum(), ll], x.T @ (w * (y - mu)), ((x * (w * mu * (1 - mu))[:, None]).T @ x).ravel()])
                sums[m] = sums.get(m, 0) + block
        for m, block in sums.items():
            yield pa.RecordBatch.from_pydict({
                "m": pa.array([m] * len(block), pa.int32()), "i": pa.array(range(len(block)), pa.int32()), "v": pa.array(block)})

    flat: dict[int, dict[int, float]] = {}
    for r in rows.mapInArrow(part, "m int, i int, v double").groupBy("m", "i").agg(F.sum("v").alias("v")).collect():
        flat.setdefault(r["m"], {})[r["i"]] = r["v"]
    out = {}
    for m, values in flat.items():
        p, v = len(used[m]), np.array([values[i] for i in range(len(values))])
        out[m] = v[0], v[1], v[2 : p + 2], v[p + 2 :].reshape(p, p)
    return out


def logits(df: DataFrame, terms: Sequence[str], models: Mapping[str, tuple[Column | None, Column]], max_iter: int = 50,
           tol: float = 1e-9) -> list[Fit]:
    """Logistic models with the same terms, {name: (condition of its rows, or None for all; outcome)}, fitted together.

    Parts may overlap. A round of Newton steps, halved where a likelihood would fall, is one pass for all models that have not
    converged, so the number of jobs does not grow with that of models. As in `logit` a model's rows are those without a missing
    predictor, outcome or condition, and a label is coded against the first level among them. Where labels alone predict, equal
    rows are counted first. A term that those before it
    determine has no estimate. A model without rows has no estimates at all.
    """
    names = list(models)
    outcomes = [f"__y{i}" for i in range(len(names))]
    columns = list(dict.fromkeys(c for t in terms for c in t.split(":")))
    answer = {o: (F.when(cond, y.cast("double")) if cond is not None else y.cast("double")) for o, (cond, y) in zip(outcomes, models.values())}
    rows = df.withColumns(answer).select(*columns, *outcomes).na.drop("all", subset=outcomes)
    rows = rows.na.drop("any", subset=columns) if columns else rows
    parts = {c: _code_parts(rows, c, outcomes) for c in columns}
    design_columns = _products(terms, {c: p for c, (p, _) in parts.items()})
    places = {n: i + 1 for i, (n, _) in enumerate(design_columns)}
    own = {m: [n for n, _ in _products(terms, {c: [(v, F.lit(1.0)) for v in held[o]] for c, (_, held) in parts.items()})]
           for m, o in enumerate(outcomes)}
    if all(isinstance(rows.schema[c].dataType, (T.StringType, T.BooleanType)) for c in columns):
        rows = rows.groupBy(*columns, *outcomes).agg(F.count(F.lit(1)).cast("double").alias("__w"))  # equal rows once, with their number
    else:
        rows = rows.withColumn("__w", F.lit(1.0))
    blocks = _kept(rows.select(
        F.col("__w").alias("w"), F.array(*[c for _, c in design_columns]).cast("array<double>").alias("x"), F.array(*[F.coalesce(F.col(o), F.lit(-1.0)) for o in outcomes]).alias("y")))
    try:
        used = {m: [0, *[places[n] for n in own[m]]] for m in own}
        state = _logit_sums(blocks, {m: np.zeros(len(used[m])) for m in used}, used)
        kept = {}
        for m, (_, _, _, h) in state.items():  # at zero the information is a quarter of the products of the design
            kept[m] = _independent(h)
            state[m] = (state[m][0], state[m][1], state[m][2][kept[m]], h[np.ix_(kept[m], kept[m])])
            used[m] = [used[m][i] for i in kept[m]]
        start = {m: (s[0], s[2][0] + s[0] / 2) for m, s in state.items()}  # n and how many answered yes
        beta = {m: np.zeros(len(used[m])) for m in state}
        step = {m: np.linalg.lstsq(s[3], s[2], rcond=None)[0] for m, s in state.items()}
        converged = dict.fromkeys(state, False)
        open_models = set(state)
        for _ in range(max_iter):
            tried = _logit_sums(blocks, {m: beta[m] + step[m] for m in open_models}, used)
            for m, new in tried.items():
                if not new[1] >= state[m][1] - 1e-12 * abs(state[m][1]):
                    step[m] = step[m] / 2
                    continue
                beta[m], state[m] = beta[m] + step[m], new
                step[m] = np.linalg.lstsq(new[3], new[2], rcond=None)[0]
                converged[m] = bool(np.abs(step[m]).max() < tol * (1 + np.abs(beta[m]).max()))
            open_models = {m for m in open_models if not converged[m]}
            if not open_models:
                break
    finally:
        blocks.unpersist()
    fits = []
    for m, name in enumerate(names):
        formula, labels = Formula("outcome", tuple(terms)), [INTERCEPT, *own[m]]
        estimate, errors = [None] * len(labels), [None] * len(labels)
        if m not in state:
            fits.append(Fit(name, formula, labels, estimate, errors, {"n": 0, "converged": 0.0}))
            continue
        n, ll, _, h = state[m]
        for i, b, v in zip(kept[m], beta[m], np.diag(np.linalg.pinv(h))):
            estimate[i], errors[i] = float(b), float(math.sqrt(max(v, 0.0)))
        yes = start[m][1]
        null = -2 * sum(k * math.log(k / n) for k in (yes, n - yes) if k > 0.25)
        fits.append(Fit(name, formula, labels, estimate, errors, {
            "n": int(n), "converged": float(converged[m]), "aic": -2 * ll + 2 * len(kept[m]), "deviance": -2 * ll, "null_deviance": null}))
    return fits


def _independent(s: np.ndarray) -> list[int]:
    """Places of a matrix of products, each of which adds something to those before it; the first always stands."""
    used = [0]
    for i in range(1, len(s)):
        rest = s[i, i] - s[i, used] @ np.linalg.solve(s[np.ix_(used, used)], s[used, i])
        if rest > 1e-9 * s[i, i]:
            used.append(i)
    return used


def log_ndtr_and_ratio(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log Φ(w) and φ(w)/Φ(w), stable far into the lower tail."""
    log_phi = -0.5 * w * w - 0.5 * math.log(2 * math.pi)
    log_cdf = np.empty_like(w)
    far = w < -3
    x = -w[far]
    ratio = np.zeros_like(x)
    for k in range(120, 0, -1):  # continued fraction of Mills' ratio
        ratio = k / (x + ratio)
    log_cdf[far] = log_phi[far] - np.log(x + ratio)
    v = w[~far]
    size = np.minimum(np.abs(v), 9.0)
    term, total = size.copy(), size.copy()
    for k in range(1, 160):
        term = term * size * size / (2 * k + 1)
        total += term
    half = np.exp(-0.5 * size * size) / math.sqrt(2 * math.pi) * total
    log_cdf[~far] = np.log(np.where(v >= 0, np.minimum(0.5 + half, 1.0), 0.5 - half))
    return log_cdf, np.exp(log_phi - log_cdf)


def _tobit_sums(rows: DataFrame, beta: np.ndarray, log_sigma: float, lower: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and Hessian; partitions send one small block each, Spark adds them up."""
    p = len(beta)

    def part(batches):
        size = p + 1
        total = np.zeros(1 + size + size * size)
        sigma = math.exp(log_sigma)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.column_stack([np.ones(len(pdf)), np.vstack(pdf["x"].to_numpy())])
            y = pdf["label"].to_numpy(float)
            mean = x @ beta
            low = y <= lower
            z = (y - mean) / sigma
            w = (lower - mean[low]) / sigma
            log_cdf, ratio = log_ndtr_and_ratio(w)
            slope = -ratio * (w + ratio)
            ll, gb, gs = np.empty(len(y)), np.empty(len(y)), np.empty(len(y))
            hbb, hbs, hss = np.empty(len(y)), np.empty(len(y)), np.empty(len(y))
            up = ~low
            ll[up] = -0.5 * z[up] ** 2 - 0.5 * math.log(2 * math.pi) - log_sigma
            gb[up], gs[up] = z[up] / sigma, z[up] ** 2 - 1
            hbb[up], hbs[up], hss[up] = -1 / sigma**2, -2 * z[up] / sigma, -2 * z[up] ** 2
            ll[low], gb[low], gs[low] = log_cdf, -ratio / sigma, -ratio * w
            hbb[low], hbs[low], hss[low] = slope / sigma**2, (w * slope + ratio) / sigma, w * w * slope + w * ratio
            h = np.zeros((size, size))
            h[:p, :p] = (x * hbb[:, None]).T @ x
            h[:p, p] = h[p, :p] = x.T @ hbs
            h[p, p] = hss.sum()
            total += np.concatenate([[ll.sum()], x.T @ gb, [gs.sum()], h.ravel()])
        yield pd.DataFrame({"k": np.arange(len(total), dtype="int32"), "v": total})

    sums = rows.mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    flat = np.array([r.v for r in sums])
    return flat[0], flat[1 : p + 2], flat[p + 2 :].reshape(p + 1, p + 1)


def tobit(formula: Formula, df: DataFrame, lower: float = 1.0, name: str = "tobit", max_iter: int = 50) -> Fit:
    """Normal regression censored from below at `lower`; Newton steps with halving, from the OLS start."""
    start = ols(formula, df)
    rows, names = design(df, formula)
    rows = _kept(rows.select("label", vector_to_array("features").alias("x")))
    try:
        if None in start.estimate:
            raise ValueError("a term is determined by those before it: " + ", ".join(n for n, b in zip(start.terms, start.estimate) if b is None))
        beta, log_sigma, converged = np.array(start.estimate), math.log(start.stats["sigma"]), False
        ll, g, h = _tobit_sums(rows, beta, log_sigma, lower)
        for _ in range(max_iter):
            curve, vectors = np.linalg.eigh(h)  # go uphill even where the likelihood is not concave
            step = -vectors @ ((vectors.T @ g) / -np.maximum(np.abs(curve), 1e-10))
            size = 1.0
            while size > 1e-6:
                new_beta, new_log = beta + size * step[:-1], log_sigma + size * step[-1]
                new = _tobit_sums(rows, new_beta, new_log, lower)
                if np.isfinite(new[0]) and new[0] >= ll - 1e-9 * abs(ll):
                    break
                size /= 2
            else:
                break
            gain = new[0] - ll
            beta, log_sigma, (ll, g, h) = new_beta, new_log, new
            if abs(gain) < 1e-10 * (abs(ll) + 1):
                converged = True
                break
        counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") <= lower).cast("long")).alias("c")).first()
    finally:
        rows.unpersist()
    errors = np.sqrt(np.diag(np.linalg.inv(-h)))
    stats = {"n": counts.n, "converged": float(converged), "censored": counts.c, "log_likelihood": ll, "sigma": math.exp(log_sigma)}
    return Fit(name, formula, [INTERCEPT, *names, "log(sigma)"], [*beta, log_sigma], list(errors), stats)


# --- moments and the one-latent model -------------------------------------------------------


NARROW = 12  # columns up to which products are summed by expressions; wider rows are multiplied as blocks


def cross_products(df: DataFrame, xs: Sequence[Column], center: np.ndarray, by: Column | None = None) -> dict[int, np.ndarray]:
    """For each value of the whole number `by` (0 without it) the sums of products of (1, x - center) over rows without a missing x."""
    p = len(xs) + 1
    names = [f"v{i}" for i in range(1, p)]
    key = (F.lit(0) if by is None else by).cast("int").alias("k")
    rows = df.select(key, *[(x.cast("double") - F.lit(float(c))).alias(n) for x, c, n in zip(xs, center, names)]).na.drop("any")
    out: dict[int, np.ndarray] = {}
    if p - 1 <= NARROW:
        z = [F.lit(1.0), *[F.col(n) for n in names]]
        places = [(i, j) for i in range(p) for j in range(i + 1)]
        for r in rows.groupBy("k").agg(*[F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i, j in places]).collect():
            m = out[r["k"]] = np.zeros((p, p))
            for i, j in places:
                m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        return out

    def part(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, own in pdf.groupby("k"):
                x = np.column_stack([np.ones(len(own)), np.vstack(own["x"].to_numpy())])
                sums[k] = sums.get(k, 0) + x.T @ x
        for k, m in sums.items():
            yield pd.DataFrame({"k": np.full(p * p, k, "int32"), "i": np.arange(p * p, dtype="int32"), "v": m.ravel()})

    block = rows.select("k", F.array(*names).alias("x")).mapInPandas(part, "k int, i int, v double")
    for r in block.groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["k"], np.zeros(p * p))[r["i"]] = r["v"]
    return {k: m.reshape(p, p) for k, m in out.items()}


def moment_matrix(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means and covariance (divisor n) of complete rows, for any number of columns.

    Few columns take one pass of covariances. Many take one for the means and one for the products of what is centred at
    them, in blocks.
    """
    p = len(cols)
    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]).na.drop("any")
    pairs = [(i, j) for i in range(p) for j in range(i + 1)] if p <= NARROW else []
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"v{i}").alias(f"m{i}") for i in range(p)], *[F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    n, means = first["n"], np.array([first[f"m{i}"] for i in range(p)], float)
    if not n:
        return 0, means, np.full((p, p), math.nan)
    if p <= NARROW:
        s = np.zeros((p, p))
        for i, j in pairs:
            s[i, j] = s[j, i] = first[f"c{i}_{j}"]
        return n, means, s
    return n, means, cross_products(rows, [F.col(f"v{i}") for i in range(p)], means)[0][1:, 1:] / n


def mimic_fit(df: DataFrame, indicators: Sequence[str], predictors: Sequence[str], name: str = "mimic",
              max_iter: int = 20000, tol: float = 1e-10) -> Fit:
    """One latent, measured by `indicators` (first loading 1), regressed on `predictors`.

    Maximum likelihood from the moment matrix by EM; standard errors from the curvature there.
    """
    q = len(indicators)
    n, _, raw = moment_matrix(df, [*indicators, *predictors])
    scale = np.sqrt(np.diag(raw))
    s = raw / np.outer(scale, scale)
    syy, sxy, sxx = s[:q, :q], s[q:, :q], s[q:, q:]
    lam, gam = np.ones(q), np.zeros(len(predictors))
    psi, theta = 0.5, np.full(q, 0.5)
    for _ in range(max_iter):
        v = 1 / (1 / psi + (lam**2 / theta).sum())
        a, b = v * gam / psi, v * lam / theta
        e_x, e_y = sxx @ a + sxy @ b, sxy.T @ a + syy @ b
        e_e = v + a @ sxx @ a + 2 * a @ sxy @ b + b @ syy @ b
        new_gam = np.linalg.solve(sxx, e_x)
        new_lam = e_y / e_e
        new_psi = e_e - new_gam @ e_x
        new_theta = np.maximum(np.diag(syy) - 2 * new_lam * e_y + new_lam**2 * e_e, 1e-8)
        first = new_lam[0]  # the scale of the latent: first loading 1
        new_lam, new_gam, new_psi = new_lam / first, new_gam * first, new_psi * first**2
        change = max(np.abs(new_lam - lam).max(), np.abs(new_gam - gam).max(), abs(new_psi - psi), np.abs(new_theta - theta).max())
        lam, gam, psi, theta = new_lam, new_gam, new_psi, new_theta
        if change < tol:
            break

    def log_lik(t: np.ndarray) -> float:
        lv, gv = np.concatenate([[1.0], t[: q - 1]]), t[q - 1 : q - 1 + len(gam)]
        pv, tv = t[-q - 1], t[-q:]
        cov = np.outer(lv, lv) * pv + np.diag(tv)
        pi = np.outer(lv, gv)
        m = syy - pi @ sxy - sxy.T @ pi.T + pi @ sxx @ pi.T
        return -n / 2 * (np.linalg.slogdet(cov)[1] + np.trace(np.linalg.solve(cov, m)))

    at = np.concatenate([lam[1:], gam, [psi], theta])
    k, eps = len(at), 1e-4
    hess = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            di, dj = eps * np.eye(k)[i], eps * np.eye(k)[j]
            hess[i, j] = hess[j, i] = (
                log_lik(at + di + dj) - log_lik(at + di - dj) - log_lik(at - di + dj) + log_lik(at - di - dj)) / (4 * eps * eps)
    se = np.sqrt(np.abs(np.diag(np.linalg.pinv(-hess))))
    y_scale, x_scale = scale[:q], scale[q:]
    back = np.concatenate([y_scale[1:] / y_scale[0], y_scale[0] / x_scale, [y_scale[0] ** 2], y_scale**2])
    terms = [f"latent=~{indicators[0]}", *[f"latent=~{i}" for i in indicators[1:]], *[f"latent~{p}" for p in predictors],
             "latent~~latent", *[f"{i}~~{i}" for i in indicators]]
    return Fit(name, Formula("latent", tuple(predictors)), terms, [1.0, *(at * back)], [None, *(se * back)],
               {"n": n, "converged": float(change < tol), "log_likelihood": float(log_lik(at))})


# --- tables of models -----------------------------------------------------------------------


def tidy_all(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    return union_all(*[f.tidy(spark) for f in fits])


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def model_table(spark: SparkSession, fits: Sequence[Fit], digits: int = 3) -> DataFrame:
    """One line per term, one column per model, "estimate*** (se)"; then n and the fit measures."""
    shape = f"%.{digits}f"
    cells = tidy_all(spark, fits).select(
        "model", "term", F.lit(1).alias("place"),
        F.concat(F.coalesce(F.format_string(shape, F.col("estimate")), F.lit("-")), stars(F.col("p")), F.lit(" ("),
                 F.coalesce(F.format_string(shape, F.col("se")), F.lit("-")), F.lit(")")).alias("text"))
    fit = union_all(*[f.glance(spark) for f in fits]).select(
        "model", F.col("stat").alias("term"), F.lit(2).alias("place"), F.format_string(shape, "value").alias("text"))
    wide = cells.unionByName(fit).groupBy("place", "term").pivot("model", [f.name for f in fits]).agg(F.first("text"))
    return wide.orderBy("place", "term").drop("place")


def subset_models(fit_one, formula: Formula, df: DataFrame, subsets: Mapping[str, Column]) -> list[Fit]:
    """The same model on several parts of the table; parts may overlap. Logistic models are fitted together."""
    if fit_one is logit:
        response = F.col(formula.response)
        fits = logits(df, formula.terms, {name: (cond, response) for name, cond in subsets.items()})
        return [replace(f, formula=formula) for f in fits]
    return [fit_one(formula, df.filter(cond), name=name) for name, cond in subsets.items()]


def std_beta(fit: Fit, df: DataFrame) -> DataFrame:
    """Estimates in standard deviations: b·sd(x)/sd(y) over the rows the model used."""
    columns, names = coded(df, fit.formula)
    sd = columns.agg(*[F.stddev_samp(c).alias(c) for c in columns.columns]).first()
    rows = [(fit.name, n, None if b is None else float(b * sd[f"x{i}"] / sd["label"]))
            for i, (n, b) in enumerate(zip(names, fit.estimate[1:]))]
    return df.sparkSession.createDataFrame(rows, "model string, term string, std_estimate double")


def coef_interval_data(spark: SparkSession, fits: Sequence[Fit], coefs: Sequence[str] | None = None, level: float = 0.95) -> DataFrame:
    """Estimates with their confidence interval, for a coefficient plot."""
    rows = []
    for f in fits:
        half = tails.t_quantile((1 + level) / 2, f.df) if f.df else tails.normal_quantile((1 + level) / 2)
        for term, b, se in zip(f.terms, f.estimate, f.se):
            if b is not None and se is not None and (coefs is None or term in coefs):
                rows.append((f.name, term, float(b), float(b - half * se), float(b + half * se)))
    return spark.createDataFrame(rows, "model string, term string, estimate double, low double, high double")


def sequential_logits(df: DataFrame, terms: Sequence[str], steps: Mapping[str, tuple[Column, Column]]) -> list[Fit]:
    """Going on to each next level among those who reached the one before: {step: (at risk, goes on)}."""
    return logits(df, terms, {name: (at_risk, r_ifelse(goes_on, True, False)) for name, (at_risk, goes_on) in steps.items()})
