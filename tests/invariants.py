"""What must hold of the queries that SQL does not express: name -> check(spark, con, folder, DataFrame)."""

import itertools
import math

import numpy as np
import pytest

from hearthline.catalog.reports import holed
from hearthline.catalog.sequences import daily
from hearthline.operators import models as L, sequences as Q, tiles as W
from test_tiles import matrix, plain_lloyd


def study_life_course(spark, con, folder, df):
    rows = df.toPandas()
    assert np.allclose(rows.groupby(["cluster", "pos"])["share"].sum(), 1)
    orders = con.sql("SELECT count(DISTINCT l_orderkey) FROM lineitem").fetchall()[0][0]
    assert (rows.groupby("pos")["n"].sum() == orders).all()


def study_parents_children_completed(spark, con, folder, df):
    con.register("completed", df.toPandas())
    base = """WITH w AS (SELECT o_custkey AS wid, sum(l_extendedprice * l_discount) AS asset FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
    m AS (SELECT o_custkey AS hhid, o_orderkey AS id, 2018 - year(o_orderdate) AS age, o_orderstatus = 'F' AS owns, o_totalprice AS v, w.asset AS a FROM orders LEFT JOIN w ON wid = o_custkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY hhid ORDER BY age DESC, id) AS place FROM m),
    s AS (SELECT *, hhid % 5 <> 0 AS told, id % 7 <> 0 AS told_v FROM r WHERE age BETWEEN 18 AND 22 AND place <= 3) """
    n, both = con.sql(base + "SELECT count(*), count(c.childid) FROM s FULL JOIN completed c ON c.childid = s.id").fetchall()[0]
    assert n == both > 0
    changed = con.sql(base + """SELECT count(*) FROM s JOIN completed c ON c.childid = s.id WHERE (told AND abs(c.asset - a) > 1e-6 * abs(a))
        OR (NOT owns AND c.homevalue <> 0) OR (owns AND told_v AND c.homevalue <> v) OR abs(c.wealth - c.asset - c.homevalue) > 1e-6 * c.wealth OR c.wealth IS NULL""").fetchall()[0][0]
    assert changed == 0  # answers stay, nobody without a home has its value, nothing is missing
    strange = con.sql(base + """SELECT count(*) FROM s JOIN completed c ON c.childid = s.id WHERE (NOT told AND round(c.asset, 4) NOT IN (SELECT round(a, 4) FROM s WHERE told AND a IS NOT NULL))
        OR (owns AND NOT told_v AND c.homevalue NOT IN (SELECT CASE WHEN owns THEN v ELSE 0.0 END FROM s WHERE told_v OR NOT owns))""").fetchall()[0][0]
    assert strange == 0  # filled values are those of a donor


def strata_summary(spark, con, folder, df):
    rows = {(r["variable"], r["label"]): r for r in df.collect()}
    for stratum, where in (("overall", "true"), ("F", "o_orderstatus = 'F'"), ("O", "o_orderstatus = 'O'"), ("P", "o_orderstatus = 'P'")):
        mean, sd, n, large = con.sql(f"SELECT avg(o_totalprice), stddev_samp(o_totalprice), count(*), count(*) FILTER (o_totalprice > 250000) FROM orders WHERE {where}").fetchall()[0]
        assert rows["o_totalprice", "Mean (SD)"][stratum] == f"{mean:,.2f} ({sd:,.2f})"
        assert rows["large", ""][stratum] == f"{large:,} ({100 * large / n:.0f}%)"
        for level, k in con.sql(f"SELECT o_orderpriority, count(*) FROM orders WHERE {where} GROUP BY 1").fetchall():
            assert rows["o_orderpriority", level][stratum] == f"{k:,} / {n:,} ({100 * k / n:.0f}%)"


def mcar(spark, con, folder, df):
    (r,) = df.collect()
    assert r["converged"] and 0 <= r["p"] <= 1 and r["statistic"] > 0
    kinds = con.sql("SELECT count(*), sum(seen) FROM (SELECT DISTINCT o_orderkey % 5 <> 0 AS a, o_custkey % 7 <> 0 AS b, 1 + a::INT + b::INT AS seen FROM orders)").fetchall()[0]
    assert r["patterns"] == kinds[0] and r["df"] == kinds[1] - 3


def least_squares(con, columns, response="l_extendedprice"):
    data = con.sql(f"SELECT {response}, {', '.join(columns)} FROM lineitem").df().to_numpy(float)
    x, y = np.column_stack([np.ones(len(data)), data[:, 1:]]), data[:, 0]
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    sigma2 = ((y - x @ b) ** 2).sum() / (len(y) - x.shape[1])
    return b, np.sqrt(sigma2 * np.diag(np.linalg.inv(x.T @ x)))


def model_table(spark, con, folder, df):
    rows = {r["term"]: r for r in df.collect()}
    for model, columns in (("m1", ["l_quantity"]), ("m2", ["l_quantity", "l_returnflag = 'N'", "l_returnflag = 'R'"])):
        b, se = least_squares(con, columns)
        for term, x, s in zip(["(Intercept)", "l_quantity", "l_returnflagN", "l_returnflagR"], b, se):
            text = rows[term][model].replace("*", "")
            estimate, error = (float(v.strip("()")) for v in text.split())
            assert estimate == pytest.approx(x, abs=2e-3) and error == pytest.approx(s, abs=2e-3)


def coef_interval(spark, con, folder, df):
    b, se = least_squares(con, ["l_quantity", "l_discount"])
    for r, x, s in zip(df.orderBy(df.term.desc()).collect(), b[1:], se[1:]):
        assert r["estimate"] == pytest.approx(x, rel=1e-6)
        assert r["high"] - r["estimate"] == pytest.approx(1.96 * s, rel=2e-3) and r["estimate"] - r["low"] == pytest.approx(1.96 * s, rel=2e-3)


def tobit(spark, con, folder, df):
    """The likelihood has no slope at the estimates."""
    rows = {r["term"]: r for r in df.collect()}
    data = con.sql("SELECT greatest(c_acctbal / 1000, 1.0)::DOUBLE, c_nationkey::DOUBLE, c_mktsegment FROM customer").fetchall()
    levels = sorted({r[2] for r in data})
    pairs = spark.createDataFrame([(y, [p, *[float(g == lv) for lv in levels[1:]]]) for y, p, g in data], "label double, x array<double>")
    terms = ["(Intercept)", "place", *[f"c_mktsegment{lv}" for lv in levels[1:]]]
    beta = np.array([rows[t]["estimate"] for t in terms])
    _, slope, curve = L._tobit_sums(pairs, beta, rows["log(sigma)"]["estimate"], 1.0)
    assert (np.abs(slope) * np.sqrt(np.diag(np.linalg.inv(-curve))) < 1e-3).all()


def mimic(spark, con, folder, df):
    """Loadings on transforms of one quantity are positive, variances too, the first loading is 1."""
    rows = {r["term"]: r["estimate"] for r in df.collect()}
    assert rows["latent=~y1"] == 1 and rows["latent=~y2"] > 0 and rows["latent=~y3"] > 0
    assert all(v > 0 for t, v in rows.items() if "~~" in t)


def imputed(spark, con, folder, df, copies=None):
    """Observed cells stand, none is missing, and every fill is a value that occurs; all copies are there and differ."""
    before = holed(spark, folder).drop("o_orderpriority").toPandas().set_index("o_orderkey").sort_index()
    rows = df.toPandas()
    parts = [rows] if copies is None else [own.drop(columns="imp") for _, own in rows.groupby("imp")]
    assert len(parts) == (copies or 1)
    for after in parts:
        after = after.set_index("o_orderkey").sort_index()
        assert (before.index == after.index).all()
        for c in ("st", "price", "prio"):
            known = before[c].notna()
            assert after[c].notna().all() and (after[c][known] == before[c][known]).all() and set(after[c]) <= set(before[c][known])
    if copies:
        assert len({tuple(p.sort_values("o_orderkey")["price"]) for p in parts}) == copies


def imputed_five(spark, con, folder, df):
    imputed(spark, con, folder, df, 5)


def om_distance(spark, con, folder, df):
    people = daily(spark, folder)
    costs = Q.substitution_costs(people, "seq")
    rows = df.toPandas()
    states = sorted({a for a, _ in costs})
    assert set(rows["steady_in"]) == set(states) and len(rows) == rows["sequence"].nunique() * len(states)
    for r in itertools.islice(rows.itertuples(), 40):
        a, n = r.sequence.split("-"), len(r.sequence.split("-"))
        d = np.zeros((n + 1, n + 1))
        d[0], d[:, 0] = range(n + 1), range(n + 1)
        for i in range(n):
            for j in range(n):
                d[i + 1, j + 1] = min(d[i, j + 1] + 1, d[i + 1, j] + 1, d[i, j] + costs[a[i], r.steady_in])
        assert r.distance == pytest.approx(d[n, n])


def om_distance_all(spark, con, folder, df):
    """All pairs, symmetric, 0 on the diagonal only, as the plain recursion has them."""
    people = daily(spark, folder, None)
    costs = Q.substitution_costs(people, "seq")
    table = {(r.sequence, r.reference): r.distance for r in df.collect()}
    names = {"-".join(r.seq) for r in Q.distinct_sequences(people, "seq").collect()}
    assert set(table) == set(itertools.product(names, names))
    assert all(v == pytest.approx(table[b, a]) and (v == 0) == (a == b) for (a, b), v in table.items())
    for x, y in itertools.islice(table, 20):
        a, b = x.split("-"), y.split("-")
        d = np.zeros((len(a) + 1, len(b) + 1))
        d[0], d[:, 0] = range(len(b) + 1), range(len(a) + 1)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            d[i + 1, j + 1] = min(d[i, j + 1] + 1, d[i + 1, j] + 1, d[i, j] + costs[a[i], b[j]])
        assert table[x, y] == pytest.approx(d[-1, -1])


def om_kmeans(spark, con, folder, df):
    rows = df.toPandas()
    assert rows["user_id"].is_unique and set(rows["cluster"]) == {0, 1, 2} and set(rows["user_id"]) == {r.user_id for r in daily(spark, folder).collect()}
    assert (rows["cluster"].map({0: "first", 1: "second", 2: "third"}) == rows["label"]).all()
    people = daily(spark, folder, None)
    names, n, d = matrix(W.tiled_distances(people, "seq", Q.substitution_costs(people, "seq")))
    best, _ = min((plain_lloyd(d * np.sqrt(n), n, 3, 1 + i) for i in range(3)), key=lambda r: r[1])
    want = dict(zip(names, best.tolist()))
    own = {r.user_id: tuple("*" if s is None else s for s in r.seq) for r in people.collect()}
    assert all(want[own[u]] == c for u, c in zip(rows["user_id"], rows["cluster"]))


def choose_k(spark, con, folder, df):
    rows = df.orderBy("k").collect()
    people = daily(spark, folder)
    feats = Q.distance_features(people, "seq", Q.steady_sequences(people, "seq")).collect()
    x, n = np.array([r.features for r in feats]), np.array([r.n for r in feats], float)
    assert rows[0]["wss"] == pytest.approx((n * ((x - (x * n[:, None]).sum(0) / n.sum()) ** 2).sum(1)).sum())
    assert [r["k"] for r in rows] == [1, 2, 3, 4, 5] and all(r["wss"] <= rows[0]["wss"] and math.isfinite(r["gap"]) and r["gap_se"] > 0 for r in rows)
    assert all(-1 <= r["silhouette"] <= 1 for r in rows[1:])


def choose_k_all(spark, con, folder, df):
    rows = df.orderBy("k").collect()
    people = daily(spark, folder, None)
    feats = Q.distance_features(people, "seq", Q.all_sequences(people, "seq")).collect()
    x, n = np.array([r.features for r in feats]), np.array([r.n for r in feats], float)
    assert x.shape == (len(x), len(x))
    assert rows[0]["wss"] == pytest.approx((n * ((x - (x * n[:, None]).sum(0) / n.sum()) ** 2).sum(1)).sum())
    assert [r["k"] for r in rows] == [1, 2, 3, 4, 5] and all(r["wss"] <= rows[0]["wss"] for r in rows)


def cluster_stability(spark, con, folder, df):
    rows = df.collect()
    assert {r["cluster"] for r in rows} == {0, 1, 2} and all(0 < r["mean_jaccard"] <= 1 and r["dissolved"] + r["recovered"] <= 10 for r in rows)


INVARIANTS = {f.__name__: f for f in (study_life_course, study_parents_children_completed, strata_summary, mcar, model_table, coef_interval, tobit, mimic, om_distance, om_distance_all, om_kmeans, choose_k, choose_k_all, cluster_stability)}
INVARIANTS |= {"impute_pmm": imputed_five, "impute_rf": imputed}
