"""Regressions and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.catalog import query, table
from hearthline.catalog.reports import HOLED, holed
from hearthline.catalog.rows import scratch
from hearthline.functions.recode import conditional_zero as zero_unless, log_shift
from hearthline.operators import impute as I, models as L
from hearthline.sources.tables import load_table, write_model_table


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def lines(spark, d):
    return table(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        (F.col("l_quantity") > 25).alias("big"))


@query(sql="""
SELECT '(Intercept)' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem
UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem""")
def ols_simple(spark, d):
    fit = L.ols(L.formula_builder("l_extendedprice", ["l_quantity"]), lines(spark, d))
    return rounded(fit.tidy(spark).select("term", "estimate"), "estimate", digits=4)


@query(sql="""
WITH m AS (SELECT l_returnflag AS g, avg(l_quantity) AS m, count(*) AS n, var_pop(l_quantity) * count(*) AS ss FROM lineitem GROUP BY 1),
s AS (SELECT sqrt(sum(ss) / (sum(n) - 3)) AS sigma FROM m), base AS (SELECT * FROM m WHERE g = 'A')
SELECT '(Intercept)' AS term, round(m, 6) AS estimate, round(sigma / sqrt(n), 6) AS se FROM base, s
UNION ALL SELECT 'l_returnflag' || m.g, round(m.m - base.m, 6), round(sigma * sqrt(1.0 / m.n + 1.0 / base.n), 6) FROM m, base, s WHERE m.g <> 'A'""")
def ols_formula(spark, d):
    fit = L.ols(L.formula_builder("l_quantity", ["l_tax"]).drop("l_tax").add("l_returnflag"), lines(spark, d))
    return rounded(fit.tidy(spark).select("term", "estimate", "se"), "estimate", "se")


_GROUP = "(SELECT regr_{0}(l_extendedprice, l_quantity) FROM lineitem WHERE l_returnflag = '{1}')"


@query(sql="SELECT '(Intercept)' AS term, round(" + _GROUP.format("intercept", "A") + ", 3) AS estimate UNION ALL SELECT 'l_quantity', round("
       + _GROUP.format("slope", "A") + ", 3)" + "".join(
           f" UNION ALL SELECT 'l_returnflag{g}', round({_GROUP.format('intercept', g)} - {_GROUP.format('intercept', 'A')}, 3)"
           f" UNION ALL SELECT 'l_quantity:l_returnflag{g}', round({_GROUP.format('slope', g)} - {_GROUP.format('slope', 'A')}, 3)" for g in "NR"))
def ols_interaction(spark, d):
    formula = L.formula_builder("l_extendedprice", ["l_quantity", "l_returnflag", "l_quantity:l_returnflag"])
    return rounded(L.ols(formula, lines(spark, d)).tidy(spark).select("term", "estimate"), "estimate", digits=3)


@query(sql="SELECT '(Intercept)' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem"
       " UNION ALL SELECT 't1', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem"
       + "".join(f" UNION ALL SELECT 't{i}', NULL" for i in range(2, 31)))
def ols_collinear(spark, d):
    """Thirty terms, each determined by the first."""
    rows = table(spark, d, "lineitem").select("l_extendedprice", *[(F.col("l_quantity") * i).alias(f"t{i}") for i in range(1, 31)])
    fit = L.ols(L.formula_builder("l_extendedprice", [f"t{i}" for i in range(1, 31)]), rows)
    return rounded(fit.tidy(spark).select("term", "estimate"), "estimate", digits=4)


@query(sql="""
SELECT 'price_logged' AS term, round(regr_slope(l_quantity, ln(l_extendedprice + 50)), 6) AS estimate FROM lineitem""")
def ols_logged_term(spark, d):
    rows = lines(spark, d).withColumn("price_logged", log_shift("l_extendedprice", 50))
    tidy = L.ols(L.Formula("l_quantity", ("price_logged",)), rows).tidy(spark)
    return rounded(tidy.filter(F.col("term") == "price_logged").select("term", "estimate"), "estimate")


@query(sql="""
SELECT 'm' AS model, 'l_discount' AS term, round(regr_slope(l_extendedprice, l_discount), 3) AS estimate FROM lineitem
UNION ALL SELECT 'm', '(Intercept)', round(regr_intercept(l_extendedprice, l_discount), 3) FROM lineitem""")
def model_table_file(spark, d):
    path = scratch(spark, "model")
    write_model_table(L.ols(L.Formula("l_extendedprice", ("l_discount",)), lines(spark, d), "m").tidy(spark), path, "parquet")
    return rounded(load_table(spark, path).select("model", "term", "estimate"), "estimate", digits=3)


@query(sql="""
WITH t AS (SELECT CAST(l_quantity > 25 AS INTEGER) AS y, l_linestatus AS g, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT max(CASE WHEN y = 1 AND g = 'F' THEN n END) a, max(CASE WHEN y = 0 AND g = 'F' THEN n END) b,
             max(CASE WHEN y = 1 AND g = 'O' THEN n END) c, max(CASE WHEN y = 0 AND g = 'O' THEN n END) d FROM t)
SELECT '(Intercept)' AS term, round(ln(a / b), 5) AS estimate, round(sqrt(1 / a + 1 / b), 5) AS se FROM c
UNION ALL SELECT 'l_linestatusO', round(ln(c / d) - ln(a / b), 5), round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 5) FROM c""")
def logit(spark, d):
    rows = L.with_outcome(lines(spark, d), F.col("l_quantity") > 25)
    return rounded(L.logit(L.Formula("outcome", ("l_linestatus",)), rows).tidy(spark).select("term", "estimate", "se"), "estimate", "se", digits=5)


@query(sql="SELECT 'l_quantity' AS term, round(corr(l_extendedprice, l_quantity), 6) AS std_estimate FROM lineitem")
def std_beta(spark, d):
    rows = lines(spark, d)
    fit = L.ols(L.Formula("l_extendedprice", ("l_quantity",)), rows)
    return rounded(L.std_beta(fit, rows).drop("model"), "std_estimate")


@query()
def model_table(spark, d):
    rows, base = lines(spark, d), L.formula_builder("l_extendedprice", ["l_quantity"])
    fits = [L.ols(base, rows, "m1"), L.ols(base.add("l_returnflag"), rows, "m2")]
    return L.model_table(spark, fits)


@query(sql="""
WITH r AS (SELECT l_returnflag AS model, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, corr(l_extendedprice, l_quantity) AS r,
           stddev_samp(l_extendedprice) AS sy, stddev_samp(l_quantity) AS sx FROM lineitem GROUP BY 1)
SELECT model, round(b, 4) AS estimate, round(sqrt((1 - r * r) / (n - 2)) * sy / sx, 4) AS se FROM r""")
def subset_models(spark, d):
    subsets = {v: F.col("l_returnflag") == v for v in ("A", "N", "R")}
    fits = L.subset_models(L.ols, L.Formula("l_extendedprice", ("l_quantity",)), lines(spark, d), subsets)
    tidy = L.tidy_all(spark, fits).filter(F.col("term") == "l_quantity")
    return rounded(tidy.select("model", "estimate", "se"), "estimate", "se", digits=4)


@query()
def coef_interval(spark, d):
    formula = L.Formula("l_extendedprice", ("l_quantity", "l_discount"))
    return L.coef_interval_data(spark, [L.ols(formula, lines(spark, d), "m")], ["l_quantity", "l_discount"])


_ODDS = """SELECT '{m}' AS model, round(ln(sum(CASE WHEN y AND big THEN 1 ELSE 0 END) / sum(CASE WHEN NOT y AND big THEN 1 ELSE 0 END))
 - ln(sum(CASE WHEN y AND NOT big THEN 1 ELSE 0 END) / sum(CASE WHEN NOT y AND NOT big THEN 1 ELSE 0 END)), 5) AS estimate
 FROM (SELECT {y} AS y, l_quantity > 25 AS big FROM lineitem WHERE {risk})"""


@query(sql=" UNION ALL ".join(_ODDS.format(m=f"reach{k + 1}", y=f"l_linenumber > {k}", risk=f"l_linenumber >= {k}") for k in (1, 3, 5)))
def sequential_logit(spark, d):
    rows = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_quantity") > 25).alias("big"))
    steps = {f"reach{k + 1}": (F.col("l_linenumber") >= k, F.col("l_linenumber") > k) for k in (1, 3, 5)}
    tidy = L.tidy_all(spark, L.sequential_logits(rows, ["big"], steps)).filter(F.col("term") == "bigTRUE")
    return rounded(tidy.select("model", "estimate"), "estimate", digits=5)


@query()
def tobit(spark, d):
    rows = table(spark, d, "customer").select(
        (F.greatest(F.col("c_acctbal") / 1000, F.lit(1.0))).alias("wealth"), F.col("c_nationkey").cast("double").alias("place"), "c_mktsegment")
    return L.tobit(L.Formula("wealth", ("place", "c_mktsegment")), rows, lower=1.0).tidy(spark)


@query()
def mimic(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("y1"), F.log("l_extendedprice").alias("y2"), F.sqrt("l_extendedprice").alias("y3"),
        F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"))
    return L.mimic_fit(rows, ["y1", "y2", "y3"], ["x1", "x2"]).tidy(spark)


# --- imputation -----------------------------------------------------------------------------


@query(sql=HOLED + """
SELECT o_orderkey, CASE WHEN price IS NOT NULL THEN price WHEN o_orderpriority = '5-LOW' THEN (SELECT median(price) FROM h) ELSE 0 END AS price FROM h""")
def fill_median(spark, d):
    rows = holed(spark, d)
    return I.fill_median(rows, "price", F.col("o_orderpriority") == "5-LOW").select("o_orderkey", "price")


@query(sql=HOLED + "SELECT o_orderkey, coalesce(st, '8 default') AS st, coalesce(prio, 1960) AS prio FROM h")
def fill_constant(spark, d):
    return I.fill_constant(holed(spark, d).select("o_orderkey", "st", "prio"), {"st": "8 default", "prio": 1960.0})


@query(sql=HOLED + "SELECT o_orderkey, CASE WHEN st = 'F' THEN price WHEN st <> 'F' THEN 0 END AS price FROM h")
def conditional_zero(spark, d):
    rows = holed(spark, d)
    return rows.select("o_orderkey", zero_unless(F.col("st") == "F", "price").alias("price"))


@query()
def impute_pmm(spark, d):
    rows = holed(spark, d).drop("o_orderpriority")
    return I.impute_mice_pmm(rows, "o_orderkey", ["st", "price", "prio"])


@query()
def impute_rf(spark, d):
    rows = holed(spark, d).drop("o_orderpriority")
    return I.complete(I.impute_mice_rf(rows, "o_orderkey", ["st", "price", "prio"]), 1)
