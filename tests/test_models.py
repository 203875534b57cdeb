import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import models as L
from hearthline.operators.models import Formula


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 1500
    x, g = rng.normal(size=n), rng.choice(["a", "b", "c"], n)
    y = 1 + 2 * x + np.where(g == "b", 1.5, 0) + rng.normal(size=n)
    z = rng.random(n) < 1 / (1 + np.exp(-(0.3 + 0.8 * x)))
    pdf = [(float(a), str(b), float(c), bool(d)) for a, b, c, d in zip(x, g, y, z)]
    return spark.createDataFrame([*pdf, (None, "a", 1.0, True)], "x double, g string, y double, z boolean"), x, g, y, z


def matrix(x, g):
    return np.column_stack([np.ones(len(x)), x, g == "b", g == "c"]).astype(float)


def reference_ols(m, y):
    b = np.linalg.solve(m.T @ m, m.T @ y)
    s2 = ((y - m @ b) ** 2).sum() / (len(y) - m.shape[1])
    return b, np.sqrt(s2 * np.diag(np.linalg.inv(m.T @ m)))


def test_ols(data):
    df, x, g, y, _ = data
    fit = L.ols(Formula("y", ("x", "g")), df)
    b, se = reference_ols(matrix(x, g), y)
    assert fit.terms == ["(Intercept)", "x", "gb", "gc"] and fit.stats["n"] == 1500
    assert fit.estimate == pytest.approx(b) and fit.se == pytest.approx(se)


@pytest.mark.parametrize("width", [5, 40])
def test_any_width_with_a_collinear_term(spark, width):
    """The same rule at any width: a term that those before it determine has no estimate, all others have their errors."""
    rng = np.random.default_rng(3)
    x = rng.normal(1e4, 1, (600, width))
    y = x @ np.arange(width) + rng.normal(size=600)
    rows = [(float(b), *map(float, a), float(2 * a[0] - a[1])) for a, b in zip(x, y)]
    names = [f"t{i}" for i in range(width + 1)]
    fit = L.ols(Formula("y", tuple(names)), spark.createDataFrame(rows, ["y", *names]))
    b, se = reference_ols(np.column_stack([np.ones(600), x - x.mean(0)]), y)
    assert fit.estimate[1:-1] == pytest.approx(b[1:], rel=1e-6, abs=1e-6) and fit.estimate[-1] is None
    assert fit.se[1:-1] == pytest.approx(se[1:], rel=1e-5) and fit.se[-1] is None


def test_interaction_has_reference_coding(data):
    df, x, g, y, _ = data
    fit = L.ols(Formula("y", ("x", "g", "x:g")), df)
    m = matrix(x, g)
    b, se = reference_ols(np.column_stack([m, x * m[:, 2], x * m[:, 3]]), y)
    assert fit.terms[-2:] == ["x:gb", "x:gc"] and fit.estimate == pytest.approx(b) and fit.se == pytest.approx(se)


def test_collinear_term_has_no_estimate(spark, data):
    fit = L.ols(Formula("y", ("x", "twice")), data[0].withColumn("twice", 2 * F.col("x")))
    assert fit.estimate[2] is None and fit.estimate[1] is not None
    assert [r.estimate is None for r in fit.tidy(spark).collect()] == [False, False, True]


def test_logit(data):
    df, x, _, _, z = data
    fit = L.logit(Formula("outcome", ("x",)), L.with_outcome(df, F.col("z")))
    m, b = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-m @ b))
        h = (m * (p * (1 - p))[:, None]).T @ m
        b = b + np.linalg.solve(h, m.T @ (z - p))
    assert fit.estimate == pytest.approx(b, rel=1e-5)
    assert fit.se == pytest.approx(np.sqrt(np.diag(np.linalg.inv(h))), rel=1e-4)


def test_logits_together(spark, data, monkeypatch):
    """As many models at once as one at a time; parts overlap, one lacks a level, one has no rows, one answer is always yes."""
    df = data[0]
    parts = {"all": None, "no a": F.col("g") != "a", "low": F.col("x") < 0.4, "none": F.col("x") > 99}
    calls, once = [], L._logit_sums
    monkeypatch.setattr(L, "_logit_sums", lambda *a: calls.append(len(a[1])) or once(*a))
    fits = L.logits(df, ["x", "g", "x:g"], {k: (c, F.col("z")) for k, c in parts.items()})
    assert len(calls) < 15 and calls[0] == 4  # rounds, not rounds times models
    for fit, cond in zip(fits[:3], list(parts.values())[:3]):
        rows = df if cond is None else df.filter(cond)
        alone = L.logit(Formula("outcome", ("x", "g", "x:g")), L.with_outcome(rows, F.col("z")))
        want, got = dict(zip(alone.terms, zip(alone.estimate, alone.se))), dict(zip(fit.terms, zip(fit.estimate, fit.se)))
        assert list(want) == list(got)
        for term in want:
            assert got[term] == pytest.approx(want[term], rel=1e-4, abs=1e-6)
        assert fit.stats["n"] == alone.stats["n"] and fit.stats["converged"] == 1
        for k in ("aic", "deviance", "null_deviance"):
            assert fit.stats[k] == pytest.approx(alone.stats[k], rel=1e-8)
    assert fits[3].stats["n"] == 0 and set(fits[3].estimate) == {None}


def test_logits_odd_designs(spark, data):
    df = data[0].withColumn("twice", F.col("x") * 2)
    one, = L.logits(df, ["x", "twice"], {"m": (None, F.col("z"))})
    alone = L.logit(Formula("outcome", ("x",)), L.with_outcome(df, F.col("z")))
    assert one.estimate[2] is None and one.estimate[:2] == pytest.approx(alone.estimate, rel=1e-5)
    bare, = L.logits(df, [], {"m": (F.col("x").isNotNull(), F.col("z"))})
    share = float(np.mean(data[4]))
    assert bare.estimate == pytest.approx([math.log(share / (1 - share))], rel=1e-8)
    apart, = L.logits(df, ["x"], {"m": (None, F.col("x") > 0)})  # separable: estimates grow without end, and the fit says so or stops flat
    assert apart.estimate[1] > 10
    never, = L.logits(df, ["x"], {"m": (None, F.col("x") > 99)})
    assert never.stats["null_deviance"] == 0 and never.estimate[0] < -10


def test_tobit(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=2000)
    y = np.maximum(1.0, 1.2 + 0.9 * x + rng.normal(size=2000) * 1.5)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = L.tobit(Formula("y", ("x",)), df, lower=1.0)

    def log_lik(t):
        mean, s = t[0] + t[1] * x, math.exp(t[2])
        low = y <= 1.0
        part = [math.log(0.5 * math.erfc(-(1 - m) / s / math.sqrt(2))) for m in mean[low]]
        return sum(part) + (-0.5 * ((y - mean)[~low] / s) ** 2 - 0.5 * math.log(2 * math.pi) - t[2]).sum()

    at = np.array(fit.estimate)
    assert fit.stats["log_likelihood"] == pytest.approx(log_lik(at), rel=1e-9)
    eps = 1e-5
    for i in range(3):
        step = eps * np.eye(3)[i]
        assert abs((log_lik(at + step) - log_lik(at - step)) / (2 * eps)) < 1e-2
        curve = (log_lik(at + 100 * step) - 2 * log_lik(at) + log_lik(at - 100 * step)) / (100 * eps) ** 2
        assert curve < 0
    assert abs(fit.estimate[1] - 0.9) < 4 * fit.se[1]


def test_normal_tail_helpers():
    w = np.array([-30.0, -8.0, -3.5, -2.9, -1.0, 0.0, 2.0, 6.0, 12.0])
    log_cdf, ratio = L.log_ndtr_and_ratio(w)
    for a, lc, r in zip(w, log_cdf, ratio):
        if a > -25:
            cdf = 0.5 * math.erfc(-a / math.sqrt(2))
            assert lc == pytest.approx(math.log(cdf), rel=1e-10, abs=1e-13)
            assert r == pytest.approx(math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / cdf, rel=1e-9)
    assert ratio[0] == pytest.approx(30.0333, rel=1e-4)


def test_mimic_recovers_the_model(spark):
    rng = np.random.default_rng(4)
    n = 4000
    x = rng.normal(size=(n, 2))
    eta = x @ [0.6, -0.4] + rng.normal(size=n) * 0.8
    y = np.column_stack([eta, 1.5 * eta, -0.7 * eta]) + rng.normal(size=(n, 3)) * 0.5
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.hstack([y, x])], "y1 double, y2 double, y3 double, x1 double, x2 double")
    fit = L.mimic_fit(df, ["y1", "y2", "y3"], ["x1", "x2"])
    want = [1.0, 1.5, -0.7, 0.6, -0.4, 0.64, 0.25, 0.25, 0.25]
    for b, se, w in zip(fit.estimate[1:], fit.se[1:], want[1:]):
        assert abs(b - w) < 4 * se and se < 0.1


def test_tables_of_models(spark, data):
    df = data[0]
    base = L.formula_builder("y", ["x"])
    fits = [L.ols(base, df, "m1"), L.ols(base.add("g").drop("nothing"), df, "m2")]
    table = {r["term"]: r for r in L.model_table(spark, fits).collect()}
    assert table["gb"]["m1"] is None and table["x"]["m1"].count("***") == 1
    band = {r.term: r for r in L.coef_interval_data(spark, fits[:1], ["x"]).collect()}
    assert list(band) == ["x"] and band["x"].low < 2 < band["x"].high
    std = {r.term: r.std_estimate for r in L.std_beta(fits[0], df).collect()}
    assert std["x"] == pytest.approx(np.corrcoef(data[1], data[3])[0, 1])
