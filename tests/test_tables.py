import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.functions import tails
from hearthline.operators import missing as M, plotdata as G, stats as ST, tables as TB

# published count tables: row level -> counts of the two or three columns, percent base, printed p
GOLDEN = [
    ({"0-25%": (124, 257), "25-50%": (129, 249), "50-75%": (144, 235), "75-100%": (136, 244)}, "row", "0.4"),
    ({"0": (34, 132), "1": (161, 248), "2": (149, 253), "3": (148, 282), "4 or more": (41, 70)}, "row", "<0.001"),
    ({"low": (1045, 79), "high": (99, 295)}, "cell", "<0.001"),
    ({"F": (484, 535), "T": (357, 705)}, "row", "<0.001"),
    ({"F": (994, 25), "T": (841, 221)}, "row", "<0.001"),
    ({"0": (193, 507), "1": (109, 349), "2 or more": (13, 94)}, "row", "0.002"),
    ({"0": (283, 224), "1": (136, 213), "2 or more": (15, 79)}, "row", "<0.001"),
    ({"low": (446, 109), "high": (109, 601)}, "cell", "<0.001"),
    ({"low": (818, 61), "high": (75, 311)}, "cell", "<0.001"),
    ({"0": (660, 33, 7), "1": (27, 411, 20), "2 or more": (8, 17, 82)}, "cell", "<0.001"),
]


def expand(spark, table):
    counts = [(r, f"c{i}", n) for r, ns in table.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(counts, "r string, c string, n int").filter("n > 0")
    return df.select("r", "c", F.explode(F.sequence(F.lit(1), "n")).alias("i"))


def percent(x):
    return str(int(x * 100 + 0.5)) if x * 100 >= 10 else f"{x * 100:.1f}"


@pytest.mark.parametrize("table, base, p", GOLDEN)
def test_published_tables(spark, table, base, p):
    df = expand(spark, table)
    width = len(next(iter(table.values())))
    wide = {r["characteristic"]: r for r in TB.cross_tab_wide(df, "r", "c", [f"c{i}" for i in range(width)], base).collect()}
    total = sum(map(sum, table.values()))
    assert wide["r"]["p_value"] == p
    for row, ns in table.items():
        for i, n in enumerate(ns):
            share = n / (sum(ns) if base == "row" else total)
            assert wide[row][f"c{i}"] == f"{n:,} ({percent(share)}%)"
        assert wide[row]["Total"] == f"{sum(ns):,} ({'100' if base == 'row' else percent(sum(ns) / total)}%)"
    assert wide["Total"]["Total"] == f"{total:,} (100%)"


def test_printed_cells(spark):
    df = expand(spark, GOLDEN[-1][0])
    row = {r["characteristic"]: r for r in TB.cross_tab_wide(df, "r", "c", ["c0", "c1", "c2"], "cell").collect()}
    assert [row["0"][c] for c in ("c0", "c1", "c2", "Total")] == ["660 (52%)", "33 (2.6%)", "7 (0.6%)", "700 (55%)"]
    assert [row["Total"][c] for c in ("c0", "c1", "c2", "Total")] == ["695 (55%)", "461 (36%)", "109 (8.6%)", "1,265 (100%)"]


def test_formats(spark):
    df = spark.createDataFrame([(0.95,), (0.23,), (0.14,), (0.05,), (0.0004,), (0.0, ), (None,)], "p double")
    assert [r[0] for r in df.select(TB.p_format(F.col("p"))).collect()] == [">0.9", "0.2", "0.14", "0.050", "<0.001", "<0.001", None]
    assert [r[0] for r in df.select(TB.percent_format(F.col("p"))).collect()] == ["95", "23", "14", "5.0", "<0.1", "0", None]


def test_empty_cell_and_missing_level(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "y")], "r string, c string")
    wide = {r["characteristic"]: r for r in TB.cross_tab_wide(df, "r", "c", ["x", "y"]).collect()}
    assert wide["a"]["y"] == "0 (0%)" and wide["Unknown"]["y"] == "1 (100%)"


def test_margins_add_up(spark):
    cells = TB.cross_tab(expand(spark, GOLDEN[1][0]), "r", "c").collect()
    inner = sum(r.n for r in cells if "Total" not in (r.row, r.col))
    assert inner == sum(r.n for r in cells if r.row == "Total" and r.col != "Total") == next(r.n for r in cells if r.row == r.col == "Total")


def test_tails():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert tails.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-10)
    assert tails.t_p(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert tails.f_sf(3.3258345304130126, 5, 10) == pytest.approx(0.05, rel=1e-8)
    assert tails.normal_p(1.959963984540054) == pytest.approx(0.05, rel=1e-10)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert tails.chi2_sf(400, 3) == pytest.approx(2.1e-86, rel=0.5)
    assert tails.exact_2x2_p(3, 4, 4, 8) == pytest.approx(0.4857142857, rel=1e-8)


def test_exact_test_for_small_tables(spark):
    df = expand(spark, {"a": (3, 1), "b": (1, 3)})
    row = TB.cross_tab_p(df, "r", "c").first()
    assert row.p == pytest.approx(0.4857142857, rel=1e-6) and row.min_expected == 2.0


def all_tables(rows, cols):
    """Every table with these margins, line by line."""
    if not rows:
        yield []
        return
    for line in itertools.product(*[range(min(rows[0], c) + 1) for c in cols]):
        if sum(line) == rows[0]:
            for rest in all_tables(rows[1:], [c - v for c, v in zip(cols, line)]):
                yield [list(line), *rest]


@pytest.mark.parametrize("table", [
    [[3, 1], [1, 3]], [[1, 4], [6, 6], [6, 0]], [[3, 3, 0], [3, 2, 1], [0, 2, 0]], [[1, 3, 3], [4, 1, 2], [1, 1, 3]],
    [[2, 0, 3, 3, 3], [3, 1, 0, 3, 0]], [[0, 0, 2], [2, 0, 1], [2, 0, 1], [2, 0, 2]], [[2, 0, 0], [0, 2, 0], [0, 0, 2]], [[0, 0], [3, 4]]])
def test_exact_test_against_all_tables(table):
    rows, cols = [sum(x) for x in table], [sum(x) for x in zip(*table)]
    weight = lambda t: math.exp(-sum(math.lgamma(v + 1) for line in t for v in line))
    seen, every = weight(table), [weight(t) for t in all_tables(rows, cols)]
    want = sum(w for w in every if w <= seen * (1 + 1e-7)) / sum(every)
    got = tails.exact_table_p(table)
    assert got is None if 0 in rows else got == pytest.approx(want, abs=1e-8)


def test_exact_test_published_and_bounded():
    job = [[1, 2, 1, 0], [3, 3, 6, 1], [10, 10, 14, 9], [6, 7, 12, 11]]  # job satisfaction by income (Agresti 2002, p. 57)
    assert tails.exact_table_p(job) == pytest.approx(0.7827, abs=5e-5)
    assert tails.exact_table_p(job, paths=1000) is None
    assert tails.exact_table_p([]) is None and tails.exact_table_p([[4, 5]]) is None


def test_report_takes_the_exact_test_of_larger_tables(spark, monkeypatch):
    small = expand(spark, {"a": (1, 4), "b": (6, 6), "c": (6, 0)})
    row = TB.cross_tab_p(small, "r", "c").first()
    assert row.test == "exact" and row.p == pytest.approx(0.019556564, abs=1e-8) and row.df == 2
    row = TB.cross_tab_p(expand(spark, {"a": (10, 40), "b": (60, 60), "c": (60, 20)}), "r", "c").first()
    assert row.test == "chi-squared"
    monkeypatch.setattr(ST, "EXACT_CELLS", 3)  # too many cells: χ², and so it says
    row = TB.cross_tab_p(small, "r", "c").first()
    assert row.test == "chi-squared, small counts" and row.p == pytest.approx(math.exp(-row.statistic / 2))
    empty = TB.cross_tab_p(small.filter("r = 'z'"), "r", "c").first()
    assert empty.p is None and empty.test is None


def test_chisq_with_empty_cell(spark):
    row = ST.chisq_test(expand(spark, {"a": (5, 0, 5), "b": (2, 8, 0)}), "r", "c").first()
    o, r, c, n = [[5, 0, 5], [2, 8, 0]], [10, 10], [7, 8, 5], 20
    want = sum((o[i][j] - r[i] * c[j] / n) ** 2 / (r[i] * c[j] / n) for i in range(2) for j in range(3))
    assert row.statistic == pytest.approx(want) and row.df == 2


def test_spearman_with_ties(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, 200), rng.integers(0, 50, 200)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)] + [(None, 1)], "x int, y int")
    got = ST.cor_spearman(df, "x", "y").first()
    assert got.n == 200 and got.rho == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_summary_text(spark):
    df = spark.createDataFrame([(1.0, "u", True), (2.0, "v", False), (6.0, "v", True), (None, None, None)], "x double, g string, f boolean")
    got = {(r.variable, r.label): r.stat for r in TB.summary_table(df).collect()}
    assert got[("x", "Mean (SD)")] == "3.00 (2.65)" and got[("x", "Minimum,Median,Maximum")] == "1.00,2.00,6.00"
    assert got[("g", "v")] == "2 / 3 (67%)" and got[("f", "")] == "2 (67%)"


def test_missing_reports(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, None, "b")], "i int, e double, s string")
    got = {r.variable: (r.n, r.missing_n) for r in M.missing_glimpse(df).collect()}
    assert got == {"i": (3, 0), "e": (0, 3), "s": (2, 1)}
    patterns = {(r.i, r.e, r.s): (r.n, r.n_missing) for r in M.missing_pattern(df, ["i", "e", "s"]).collect()}
    assert patterns == {(1, 0, 1): (2, 1), (1, 0, 0): (1, 2)}


def test_mcar_of_many_columns_and_patterns(spark, monkeypatch):
    """Twelve columns; the rounds on the driver and those in Spark agree."""
    rng = np.random.default_rng(12)
    z = rng.normal(size=(400, 12))
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r) for r in z]
    df = spark.createDataFrame(rows, [f"v{i}" for i in range(12)])
    own = M.mcar_test(df, df.columns, max_iter=3).first()
    monkeypatch.setattr(M, "COLLECTED", 1)
    spread = M.mcar_test(df, df.columns, max_iter=3).first()
    assert spread["statistic"] == pytest.approx(own["statistic"]) and spread["df"] == own["df"] and spread["patterns"] == own["patterns"] > 50


def test_mcar(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    z = rng.multivariate_normal([0, 1, 2], [[1, 0.5, 0.3], [0.5, 1, 0.4], [0.3, 0.4, 1]], 800)
    def table(gone):
        return spark.createDataFrame([(float(a), None if g else float(b), float(c)) for (a, b, c), g in zip(z, gone)], "a double, b double, c double")
    random = M.mcar_test(table(rng.random(800) < 0.3), ["a", "b", "c"]).first()
    driven = M.mcar_test(table(z[:, 0] > 0.5), ["a", "b", "c"]).first()
    assert random.df == driven.df == 2 and random.p > 0.001 and driven.p < 1e-10


def test_box_limits_drop_rows_first(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 4, 5, 100, 1000]], "g string, x double")
    row = G.boxplot_data(df, "g", "x", (0, 100)).first()
    assert (row.q50, row.low, row.high, row.n_outliers) == (3.5, 1.0, 5.0, 1)


def test_anova_far_from_zero(spark):
    """Equal means at 10^7: squares would swamp the differences."""
    rows = [(g, 1e7 + ((i * 7919) % 1000) / 1000) for g in "abc" for i in range(3000)]
    r = ST.anova_f(spark.createDataFrame(rows, "g string, x double"), "x", "g").first()
    assert 0 <= r["statistic"] < 1e-6 and r["p"] > 0.999


def test_t_test_wants_two_levels(spark):
    from pyspark.errors import PySparkException

    rows = [(g, float(i)) for g in "abc" for i in range(4)]
    with pytest.raises(PySparkException, match="two levels"):
        ST.t_test(spark.createDataFrame(rows, "g string, x double"), "x", "g").collect()


def test_strata_come_from_one_summary(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    plan = TB.summary_by_strata(df, "o_orderstatus", ["F", "O", "P"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 5


def test_risk_sets(spark):
    rows = [("TRUE", "TRUE"), ("FALSE", "dropout"), ("dropout", "dropout"), (None, "TRUE"), ("TRUE", None)]
    got = TB.transition_tables(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).collect()
    assert {r["row"] for r in got} - {"Total"} == {"TRUE", "FALSE"} and max(r["n"] for r in got) == 3
