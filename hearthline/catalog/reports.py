"""Cross-tabs, summaries, tests, missingness and plot data."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.catalog import query, table
from hearthline.catalog.scalars import QUARTER_LABELS, QUARTERS, STATUS, status
from hearthline.operators import household as HH, missing as M, plotdata as G, stats as ST, tables as TB
from hearthline.operators.shape import mutate_at


def rounded(df, *cols, digits=6):
    return mutate_at(df, cols, lambda x: F.round(x, digits))


# a percentage as the reports write it
PCT = ("CASE WHEN share * 100 >= 10 THEN CAST(CAST(round(share * 100) AS INTEGER) AS VARCHAR) WHEN share = 0 THEN '0' "
       "WHEN share * 100 < 0.1 THEN '<0.1' ELSE printf('%.1f', round(share * 100, 1)) END")
CUBE = """cells AS (SELECT coalesce(r, 'Total') AS row, coalesce(c, 'Total') AS col, count(*) AS n, grouping(r) AS gr, grouping(c) AS gc
          FROM pairs GROUP BY CUBE (r, c))"""


def _tab(base: str, shares: str) -> str:
    return f"""WITH pairs AS ({base}), {CUBE}, shares AS ({shares})
SELECT row, col, n, round(share, 8) AS share, format('{{:,}}', n) || ' (' || {PCT} || '%)' AS text FROM shares"""


ROW_SHARE = "SELECT a.row, a.col, a.n, a.n / b.n AS share FROM cells a JOIN cells b ON a.row = b.row AND b.gc = 1 AND a.gr = b.gr"
CELL_SHARE = "SELECT row, col, n, n / (SELECT n FROM cells WHERE gr = 1 AND gc = 1) AS share FROM cells"
ST_UNKNOWN = f"SELECT o_orderpriority AS r, coalesce({STATUS}, 'Unknown') AS c FROM orders"


def tidy(df):
    return df.withColumn("share", F.round("share", 8))


@query(sql=_tab(ST_UNKNOWN, ROW_SHARE))
def cross_tab_row(spark, d):
    return tidy(TB.cross_tab(table(spark, d, "orders").withColumn("st", status()), "o_orderpriority", "st", "row"))


@query(sql=_tab("SELECT CAST(quality AS VARCHAR) AS r, CAST(toxic AS VARCHAR) AS c FROM labels", CELL_SHARE))
def cross_tab_cell(spark, d):
    return tidy(TB.cross_tab(table(spark, d, "labels"), "quality", "toxic", "cell"))


CHI = """
, ct AS (SELECT r, c, count(*)::DOUBLE AS o FROM pairs GROUP BY 1, 2), rs AS (SELECT r, sum(o) AS rt FROM ct GROUP BY 1),
  cs AS (SELECT c, sum(o) AS ctot FROM ct GROUP BY 1), tot AS (SELECT sum(o) AS n FROM ct),
  full_ AS (SELECT coalesce(o, 0) AS o, rt * ctot / n AS e FROM rs CROSS JOIN cs CROSS JOIN tot LEFT JOIN ct ON ct.r = rs.r AND ct.c = cs.c) """


@query(sql="WITH pairs AS (" + ST_UNKNOWN + ")" + CHI + """
SELECT round(sum((o - e) * (o - e) / e), 6) AS statistic, CAST(((SELECT count(*) FROM rs) - 1) * ((SELECT count(*) FROM cs) - 1) AS DOUBLE) AS df,
       CAST(sum(o) AS BIGINT) AS n, round(min(e), 4) AS min_expected FROM full_""")
def cross_tab_p(spark, d):
    test = TB.cross_tab_p(table(spark, d, "orders").withColumn("st", status()), "o_orderpriority", "st")
    return rounded(test.select("statistic", "df", "n", F.round("min_expected", 4).alias("min_expected")), "statistic")


_WAYS = "lgamma(n + 1) - lgamma({0} + 1) - lgamma(n - {0} + 1)"


@query(sql="WITH RECURSIVE pairs AS (SELECT r_name AS r, s_acctbal < 0 AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
       + CHI + f"""
, x AS (SELECT sum((o - e) * (o - e) / e) AS x, min(e) AS low FROM full_),
l AS (SELECT row_number() OVER (ORDER BY r) AS i, count(*) AS n, sum(c::INT) AS k FROM pairs GROUP BY r),
w AS (SELECT i, n, k, unnest(range(0, n + 1)) AS v FROM l, x WHERE low < 5),
t AS (SELECT 0::BIGINT AS i, 0::HUGEINT AS s, 0.0::DOUBLE AS lw UNION ALL
      SELECT t.i + 1, t.s + v, t.lw + {_WAYS.format('v')} FROM t JOIN w ON w.i = t.i + 1 WHERE t.s + v <= (SELECT sum(k) FROM l)),
done AS (SELECT lw FROM t WHERE i = (SELECT max(i) FROM l) AND s = (SELECT sum(k) FROM l)),
seen AS (SELECT sum({_WAYS.format('k')}) AS lw FROM l)
SELECT round(x, 6) AS statistic, CAST((SELECT sum(n) FROM l) AS BIGINT) AS n, round(low, 4) AS min_expected,
       round(CASE WHEN (SELECT count(*) FROM cs) < 2 THEN NULL WHEN low < 5 THEN (SELECT sum(exp(d.lw - q.top) ) FILTER (d.lw <= s.lw + 1e-7) / sum(exp(d.lw - q.top)) FROM done d, seen s, (SELECT max(lw) AS top FROM done) q)
                  ELSE exp(-x / 2) * (1 + x / 2) END, 6) AS p,
       CASE WHEN (SELECT count(*) FROM cs) < 2 THEN NULL WHEN low < 5 THEN 'exact' ELSE 'chi-squared' END AS test FROM x""")
def cross_tab_exact(spark, d):
    """Suppliers in debt by region: with few suppliers the exact test of a 5×2 table, with many χ²."""
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("debt", F.col("s_acctbal") < 0)
    test = rounded(TB.cross_tab_p(rows, "r_name", "debt"), "statistic", "p")
    return test.select("statistic", "n", F.round("min_expected", 4).alias("min_expected"), "p", "test")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
# with 12 degrees of freedom the tail probability of x is exp(-x/2) (1 + x/2 + (x/2)^2/2! + ... + (x/2)^5/5!)
_TAIL = "exp(-x / 2) * (1 + x / 2 + power(x / 2, 2) / 2 + power(x / 2, 3) / 6 + power(x / 2, 4) / 24 + power(x / 2, 5) / 120)"
_P_TEXT = ("CASE WHEN p > 0.9 THEN '>0.9' WHEN p < 0.001 THEN '<0.001' WHEN round(p, 1) >= 0.2 THEN printf('%.1f', p) "
           "WHEN round(p, 2) >= 0.1 THEN printf('%.2f', p) ELSE printf('%.3f', p) END")


@query(sql="""
WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) b1, quantile_cont(c_acctbal, 0.5) b2, quantile_cont(c_acctbal, 0.75) b3 FROM customer),
pairs AS (SELECT CASE WHEN c_acctbal <= b1 THEN '0-25%' WHEN c_acctbal <= b2 THEN '25-50%' WHEN c_acctbal <= b3 THEN '50-75%' ELSE '75-100%' END AS r,
          c_mktsegment AS c FROM customer, q), """ + CUBE + ", shares AS (" + ROW_SHARE + ")" + CHI + f"""
SELECT row AS characteristic, {", ".join(f"max(CASE WHEN col = '{v}' THEN text END) AS {v}" for v in SEGMENTS)},
       max(CASE WHEN col = 'Total' THEN text END) AS Total, NULL AS p_value
FROM (SELECT row, col, format('{{:,}}', n) || ' (' || {PCT} || '%)' AS text FROM shares) GROUP BY 1
UNION ALL SELECT 'bin', NULL, NULL, NULL, NULL, NULL, NULL, {_P_TEXT}
FROM (SELECT {_TAIL} AS p FROM (SELECT sum((o - e) * (o - e) / e) AS x FROM full_))""")
def cross_tab_report(spark, d):
    people = HH.quantile_bin(table(spark, d, "customer"), "c_acctbal", QUARTERS, QUARTER_LABELS)
    return TB.cross_tab_wide(people, "bin", "c_mktsegment", SEGMENTS)


@query(sql="WITH pairs AS (SELECT quality AS r, toxic AS c FROM labels)" + CHI + """
SELECT round(sum(power(greatest(abs(o - e) - 0.5, 0), 2) / e), 6) AS statistic, CAST(1 AS DOUBLE) AS df, CAST(sum(o) AS BIGINT) AS n FROM full_""")
def chisq_stat(spark, d):
    return rounded(ST.chisq_test(table(spark, d, "labels"), "quality", "toxic").select("statistic", "df", "n"), "statistic")


_STEP = "SELECT '{0} -> {1}' AS step, * FROM (" + _tab("SELECT CAST({0} AS VARCHAR) AS r, CAST({1} AS VARCHAR) AS c FROM base", ROW_SHARE).replace("{:,}", "{{:,}}") + ")"


@query(sql="WITH base AS (SELECT l_returnflag AS a, l_linestatus AS b, CASE WHEN l_linenumber > 3 THEN 'late' ELSE 'early' END AS z FROM lineitem) "
       + _STEP.format("a", "b") + " UNION ALL " + _STEP.format("b", "z"))
def transition_tables(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"),
        F.when(F.col("l_linenumber") > 3, "late").otherwise("early").alias("z"))
    return tidy(TB.transition_tables(rows, ["a", "b", "z"]))


_CHI = """SELECT '{0} -> {1}' AS step, round(sum(n) * (sum(n * n / (r * c)) - 1), 6) AS statistic, CAST((count(DISTINCT {0}) - 1) * (count(DISTINCT {1}) - 1) AS DOUBLE) AS df,
CAST(sum(n) AS BIGINT) AS n FROM (SELECT {0}, {1}, n, sum(n) OVER (PARTITION BY {0}) AS r, sum(n) OVER (PARTITION BY {1}) AS c FROM
(SELECT {0}, {1}, count(*)::DOUBLE AS n FROM base WHERE {0} NOT IN ('R') GROUP BY 1, 2))"""


@query(sql="WITH base AS (SELECT l_returnflag AS a, l_linestatus AS b, CASE WHEN l_linenumber > 3 THEN 'late' ELSE 'early' END AS z FROM lineitem) "
       + _CHI.format("a", "b") + " UNION ALL " + _CHI.format("b", "z"))
def transition_tests(spark, d):
    """Lines of flag R have left and are not at risk in the step from a to b."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"),
        F.when(F.col("l_linenumber") > 3, "late").otherwise("early").alias("z"))
    return TB.transition_tests(rows, ["a", "b", "z"], left=["R"]).select("step", F.round("statistic", 6).alias("statistic"), F.col("df").cast("double").alias("df"), "n")


_NUM = """SELECT {key} '{v}' AS variable, count({v}) AS n, round(avg({v}), 5) AS mean, round(stddev_samp({v}), 5) AS sd, CAST(min({v}) AS DOUBLE) AS min,
round(quantile_cont({v}, 0.25), 5) AS q25, round(median({v}), 5) AS median, round(quantile_cont({v}, 0.75), 5) AS q75, CAST(max({v}) AS DOUBLE) AS max FROM {t} {group}"""


def _num(t, v, key="", group=""):
    return _NUM.format(t=t, v=v, key=key, group=group)


def _round_summary(df):
    return rounded(df, "mean", "sd", "q25", "median", "q75", digits=5)


@query(sql=_num("part", "p_size") + " UNION ALL " + _num("part", "p_retailprice"))
def numeric_summary(spark, d):
    return _round_summary(TB.numeric_summary(table(spark, d, "part"), ["p_size", "p_retailprice"]))


@query(sql="""
SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 5) AS mean, round(stddev_samp(o_totalprice), 5) AS sd,
       round(quantile_cont(o_totalprice, 0.25), 5) AS q25, round(median(o_totalprice), 5) AS q50, round(quantile_cont(o_totalprice, 0.75), 5) AS q75
FROM orders GROUP BY 1""")
def distribution_table(spark, d):
    return rounded(TB.distribution_table(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), "mean", "sd", "q25", "q50", "q75", digits=5)


@query(sql=f"""
SELECT 'o_orderpriority' AS variable, o_orderpriority AS label, format('{{:,}}', n) || ' / ' || format('{{:,}}', total) || ' (' || {PCT} || '%)' AS stat
FROM (SELECT o_orderpriority, count(*) AS n, (SELECT count(*) FROM orders) AS total, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1)
UNION ALL SELECT 'st', st, format('{{:,}}', n) || ' / ' || format('{{:,}}', total) || ' (' || {PCT} || '%)'
FROM (SELECT {STATUS} AS st, count(*) AS n, (SELECT count({STATUS}) FROM orders) AS total, count(*) / (SELECT count({STATUS}) FROM orders) AS share FROM orders WHERE {STATUS} IS NOT NULL GROUP BY 1)
UNION ALL SELECT 'large', '', format('{{:,}}', n) || ' (' || {PCT} || '%)'
FROM (SELECT count(CASE WHEN o_totalprice > 250000 THEN 1 END) AS n, n / count(*) AS share FROM orders)
UNION ALL SELECT 'year', 'Mean (SD)', format('{{:,.2f}}', avg(year(o_orderdate))) || ' (' || format('{{:,.2f}}', stddev_samp(year(o_orderdate))) || ')' FROM orders
UNION ALL SELECT 'year', 'Minimum,Median,Maximum', format('{{:,.2f}}', min(year(o_orderdate))::DOUBLE) || ',' || format('{{:,.2f}}', median(year(o_orderdate))) || ',' || format('{{:,.2f}}', max(year(o_orderdate))::DOUBLE) FROM orders""")
def summary_table(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderpriority", status().alias("st"), (F.col("o_totalprice") > 250000).alias("large"), F.year("o_orderdate").alias("year"))
    return TB.summary_table(rows)


@query(sql=_num("orders", "o_totalprice", "o_orderstatus,", "GROUP BY o_orderstatus"))
def strata_numbers(spark, d):
    return _round_summary(TB.numeric_summary(table(spark, d, "orders"), ["o_totalprice"], ["o_orderstatus"]))


@query(sql="""
SELECT o_orderstatus, 'o_orderpriority' AS variable, o_orderpriority AS level, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total,
       round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 8) AS share FROM orders GROUP BY 1, 3""")
def strata_levels(spark, d):
    return tidy(TB.level_counts(table(spark, d, "orders"), ["o_orderpriority"], ["o_orderstatus"]))


@query(sql="SELECT " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 5) AS b{i}" for i, p in enumerate([0, 0.1, 0.5, 0.9, 1])) + " FROM orders")
def quantile_breaks(spark, d):
    breaks = HH.quantile_breaks(table(spark, d, "orders"), "o_totalprice", [0, 0.1, 0.5, 0.9, 1])
    return rounded(breaks, *breaks.columns, digits=5)


@query()
def strata_summary(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice", (F.col("o_totalprice") > 250000).alias("large"))
    return TB.summary_by_strata(rows, "o_orderstatus", ["F", "O", "P"])


_DESC = _num("customer", "c_acctbal")


@query(sql=f"""
WITH s AS ({_DESC}) SELECT variable, 'n' AS stat, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT variable, 'mean', mean FROM s
UNION ALL SELECT variable, 'sd', sd FROM s UNION ALL SELECT variable, 'min', min FROM s UNION ALL SELECT variable, 'max', max FROM s
UNION ALL SELECT variable, 'q25', q25 FROM s UNION ALL SELECT variable, 'median', median FROM s UNION ALL SELECT variable, 'q75', q75 FROM s
UNION ALL SELECT 'c_mktsegment', 'n:' || c_mktsegment, CAST(count(*) AS DOUBLE) FROM customer GROUP BY c_mktsegment""")
def describe(spark, d):
    return rounded(TB.describe(table(spark, d, "customer"), ["c_acctbal"], ["c_mktsegment"]), "value", digits=5)


# --- tests ----------------------------------------------------------------------------------


@query(sql="""
WITH a AS (SELECT count(*) n, avg(l_quantity) m, var_samp(l_quantity) v FROM lineitem WHERE l_linestatus = 'F'),
     b AS (SELECT count(*) n, avg(l_quantity) m, var_samp(l_quantity) v FROM lineitem WHERE l_linestatus = 'O')
SELECT round(a.m, 6) AS mean_a, round(b.m, 6) AS mean_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) AS statistic,
       round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 3) AS df FROM a, b""")
def welch_t(spark, d):
    t = ST.t_test(table(spark, d, "lineitem"), "l_quantity", "l_linestatus")
    return t.select(F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"),
                    F.round("statistic", 5).alias("statistic"), F.round("df", 3).alias("df"))


@query(sql="""
WITH g AS (SELECT p_brand, count(*) n, avg(p_retailprice) m, var_samp(p_retailprice) v FROM part GROUP BY 1),
     t AS (SELECT sum(n) n, sum(n * m) / sum(n) m, count(*) k FROM g)
SELECT round((sum(g.n * power(g.m - t.m, 2)) / (t.k - 1)) / (sum((g.n - 1) * g.v) / (t.n - t.k)), 5) AS statistic,
       CAST(t.k - 1 AS BIGINT) AS df1, CAST(t.n - t.k AS BIGINT) AS df2 FROM g, t GROUP BY t.k, t.n""")
def anova_f(spark, d):
    return rounded(ST.anova_f(table(spark, d, "part"), "p_retailprice", "p_brand").select("statistic", "df1", "df2"), "statistic", digits=5)


@query(sql="""
WITH x AS (SELECT l_quantity, count(*) AS c, sum(count(*)) OVER (ORDER BY l_quantity) - (count(*) - 1) / 2 AS r FROM lineitem GROUP BY 1),
     y AS (SELECT l_extendedprice, sum(count(*)) OVER (ORDER BY l_extendedprice) - (count(*) - 1) / 2 AS r FROM lineitem GROUP BY 1)
SELECT count(*) AS n, round(corr(x.r, y.r), 6) AS rho FROM lineitem l JOIN x ON l.l_quantity = x.l_quantity JOIN y ON l.l_extendedprice = y.l_extendedprice""")
def spearman(spark, d):
    return rounded(ST.cor_spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "rho")


@query(sql="""
SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1""")
def pearson(spark, d):
    return rounded(ST.cor_pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), "r")


# --- missing data ---------------------------------------------------------------------------


def holed(spark, d):
    """Orders with missing values: label, number and a second number."""
    prio = F.substring("o_orderpriority", 1, 1).cast("double")
    return table(spark, d, "orders").select(
        "o_orderkey", status().alias("st"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_custkey") % 7 != 0, prio).alias("prio"), "o_orderpriority")


HOLED = f"""WITH h AS (SELECT o_orderkey, {STATUS} AS st, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price,
CASE WHEN o_custkey % 7 <> 0 THEN CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) END AS prio, o_orderpriority FROM orders) """


def _gl(v, t):
    return f"SELECT '{v}' AS variable, '{t}' AS type, count({v}) AS n, count(*) - count({v}) AS missing_n, round(100.0 * (count(*) - count({v})) / count(*), 4) AS missing_percent FROM h"


@query(sql=HOLED + " UNION ALL ".join(_gl(v, t) for v, t in [
    ("o_orderkey", "bigint"), ("st", "string"), ("price", "double"), ("prio", "double"), ("o_orderpriority", "string")]))
def missing_glimpse(spark, d):
    return rounded(M.missing_glimpse(holed(spark, d)), "missing_percent", digits=4)


@query(sql=HOLED + """, s AS (""" + _num("h", "price") + " UNION ALL " + _num("h", "prio") + """),
l AS (SELECT 'st' AS variable, count(DISTINCT st) AS n_levels FROM h UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM h),
g AS (""" + " UNION ALL ".join(_gl(v, t) for v, t in [("st", "string"), ("price", "double"), ("prio", "double"), ("o_orderpriority", "string")]) + """)
SELECT g.*, mean, sd, min, q25, median, q75, max, n_levels FROM g LEFT JOIN s ON g.variable = s.variable LEFT JOIN l ON g.variable = l.variable""")
def full_glimpse(spark, d):
    return _round_summary(rounded(M.full_glimpse(holed(spark, d).drop("o_orderkey")), "missing_percent", digits=4))


@query(sql=HOLED + """SELECT CAST(st IS NOT NULL AS INTEGER) AS st, CAST(price IS NOT NULL AS INTEGER) AS price, CAST(prio IS NOT NULL AS INTEGER) AS prio,
count(*) AS n, CAST(st IS NULL AS INTEGER) + CAST(price IS NULL AS INTEGER) + CAST(prio IS NULL AS INTEGER) AS n_missing FROM h GROUP BY ALL""")
def missing_pattern(spark, d):
    return M.missing_pattern(holed(spark, d), ["st", "price", "prio"])


@query(sql=HOLED + "SELECT count(*) - count(st) AS st, count(*) - count(price) AS price, count(*) - count(prio) AS prio FROM h")
def missing_pattern_totals(spark, d):
    return M.missing_pattern_totals(holed(spark, d), ["st", "price", "prio"])


@query(sql=HOLED + """, k AS (SELECT *, price IS NULL AS c FROM h),
g AS (SELECT c, count(prio) n, avg(prio) m, var_samp(prio) v FROM k GROUP BY 1), t AS (SELECT sum(n) n, sum(n * m) / sum(n) m FROM g),
pairs AS (SELECT st AS r, c FROM k WHERE st IS NOT NULL)""" + CHI + """
SELECT 'prio' AS variable, 'F' AS test, round(sum(g.n * power(g.m - t.m, 2)) / (sum((g.n - 1) * g.v) / (max(t.n) - 2)), 5) AS statistic FROM g, t
UNION ALL SELECT 'st', 'chisq', round(sum(power(greatest(abs(o - e) - 0.5, 0), 2) / e), 5) FROM full_""")
def missing_compare(spark, d):
    return rounded(M.missing_compare(holed(spark, d), "price", ["prio", "st"]).drop("p"), "statistic", digits=5)


@query()
def mcar(spark, d):
    return M.mcar_test(holed(spark, d).withColumn("key", F.col("o_orderkey")), ["price", "prio", "key"])


# --- plot data ------------------------------------------------------------------------------


@query(sql=f"""
SELECT {STATUS} AS st, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 5) AS mean FROM orders WHERE {STATUS} IS NOT NULL GROUP BY 1, 2""")
def line_points(spark, d):
    return rounded(G.line_points_data(table(spark, d, "orders").withColumn("st", status()), "st", "o_orderpriority", "o_totalprice"), "mean", digits=5)


@query(sql="""
SELECT p_type, count(*) AS n, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 5) AS intercept,
       min(p_size) AS x_min, max(p_size) AS x_max FROM part GROUP BY 1""")
def scatter_lm(spark, d):
    return rounded(rounded(G.scatter_lm_data(table(spark, d, "part"), "p_type", "p_size", "p_retailprice"), "slope"), "intercept", digits=5)


@query(sql="SELECT p_partkey, p_size, p_retailprice FROM part WHERE md5('7:' || p_partkey) < '33333333'")
def scatter_points(spark, d):
    return G.scatter_points(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_partkey"], 0.2, 7)


@query(sql="""
WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS x FROM orders WHERE o_totalprice BETWEEN 0 AND 300000),
b AS (SELECT g, quantile_cont(x, 0.25) q25, quantile_cont(x, 0.5) q50, quantile_cont(x, 0.75) q75 FROM r GROUP BY 1),
w AS (SELECT r.g, q25, q50, q75, x, x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM r JOIN b ON r.g = b.g)
SELECT g AS o_orderpriority, round(q25, 5) AS q25, round(q50, 5) AS q50, round(q75, 5) AS q75, min(CASE WHEN inside THEN x END) AS low,
       max(CASE WHEN inside THEN x END) AS high, count(CASE WHEN NOT inside THEN 1 END) AS n_outliers FROM w GROUP BY g, w.q25, w.q50, w.q75""")
def boxplot(spark, d):
    return rounded(G.boxplot_data(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", (0, 300000)), "q25", "q50", "q75", digits=5)


@query(sql="""
WITH m AS (SELECT l_returnflag, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM lineitem GROUP BY 1)
SELECT l_returnflag, 'l_quantity' AS part, round(l_quantity, 6) AS mean FROM m UNION ALL SELECT l_returnflag, 'l_discount', round(l_discount, 6) FROM m
UNION ALL SELECT l_returnflag, 'l_tax', round(l_tax, 6) FROM m""")
def stacked_bar(spark, d):
    return rounded(G.stacked_bar_data(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount", "l_tax"]), "mean")


@query(sql="SELECT floor((p_size + 2.5) / 5) * 5 AS center, count(*) AS n FROM part GROUP BY 1")
def histogram(spark, d):
    return G.variable_plot_data(table(spark, d, "part"), "p_size")


@query(sql="SELECT p_type AS level, count(*) AS n FROM part GROUP BY 1")
def bar_counts(spark, d):
    return G.variable_plot_data(table(spark, d, "part"), "p_type")
