"""Scalar functions (recoding, units, text, derived survey columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline.catalog import query, table
from hearthline.functions import codebook, household as H, recode as R, text as X
from hearthline.operators import link, shape
from hearthline.operators.household import quantile_bin
from hearthline.sources.labelled import decode_labels

STATUS = "nullif(o_orderstatus, 'P')"  # a label column with missing values, in both engines
PRIO_NO = "cast(substr(o_orderpriority, 1, 1) AS INTEGER)"


def status() -> Column:
    return F.nullif(F.col("o_orderstatus"), F.lit("P"))


@query(sql="""
SELECT c_custkey, n.n_name AS c_nationkey FROM customer JOIN nation n ON c_nationkey = n_nationkey""")
def label_decode(spark, d):
    labels = table(spark, d, "nation").select(
        F.lit("c_nationkey").alias("col"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label")
    )
    return decode_labels(table(spark, d, "customer").select("c_custkey", "c_nationkey"), labels, ["c_nationkey"])


@query(sql=f"""
SELECT o_orderkey, coalesce({STATUS} IN ('F', 'X'), false) AS in_list,
       coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false) AS urgent FROM orders""")
def code_list_in(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", R.in_set(status(), ["F", "X"]).alias("in_list"),
        R.in_set("o_orderpriority", ["1-URGENT", "2-HIGH"]).alias("urgent"),
    )


@query(sql="""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'top' WHEN '5-LOW' THEN 'bottom' ELSE o_orderpriority END AS kept,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'top' WHEN '5-LOW' THEN 'bottom' END AS strict FROM orders""")
def recode_keep(spark, d):
    names = {"1-URGENT": "top", "5-LOW": "bottom"}
    return table(spark, d, "orders").select(
        "o_orderkey", R.recode_labels("o_orderpriority", names).alias("kept"),
        R.recode_labels("o_orderpriority", names, keep=False).alias("strict"),
    )


def _case(expr, values, other):
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values) + f" ELSE {other} END"


@query(sql=f"""
SELECT p_partkey,
       {_case("p_size", enumerate(codebook.SCHOOLING_YEARS, 1), "p_size")} AS years,
       {_case("p_size", enumerate(codebook.SCHOOLING_YEARS_RELATIVE, 1), "NULL")} AS relative_years,
       {_case("p_size", enumerate(codebook.INCOME_BAND_AMOUNT, 1), "NULL")} AS income FROM part""")
def recode_positional(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", R.recode_positional("p_size", codebook.SCHOOLING_YEARS).alias("years"),
        R.recode_positional("p_size", codebook.SCHOOLING_YEARS_RELATIVE, keep=False).alias("relative_years"),
        R.recode_positional("p_size", codebook.INCOME_BAND_AMOUNT, keep=False).alias("income"),
    )


@query(sql=f"""
SELECT p_partkey, {_case("p_size", ((k, repr(v)) for k, v in codebook.JOB_RANK.items()), "NULL")} AS rank
FROM part""")
def recode_codes(spark, d):
    return table(spark, d, "part").select("p_partkey", R.recode_codes("p_size", codebook.JOB_RANK).alias("rank"))


@query(sql="""
SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
       WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE o_orderpriority END AS level FROM orders""")
def collapse_levels(spark, d):
    merge = {"1-URGENT": "high", "2-HIGH": "high", "4-NOT SPECIFIED": None}
    return table(spark, d, "orders").select("o_orderkey", R.collapse_levels("o_orderpriority", merge).alias("level"))


@query(sql=f"""
SELECT o_orderkey, CASE WHEN {STATUS} = 'F' THEN o_totalprice WHEN NOT ({STATUS} = 'F') THEN 0.0 END AS x,
       CASE WHEN {STATUS} = 'F' THEN CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END
            WHEN {STATUS} <> 'F' THEN 'open' END AS nested FROM orders""")
def r_ifelse_null(spark, d):
    done = status() == "F"
    return table(spark, d, "orders").select(
        "o_orderkey", R.r_ifelse(done, F.col("o_totalprice"), F.lit(0.0)).alias("x"),
        R.r_ifelse(done, R.r_ifelse(F.col("o_totalprice") > 100000, "big", "small"), "open").alias("nested"),
    )


@query(sql="""
SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 12 THEN 'low' WHEN p_size BETWEEN 15 AND 22 THEN 'mid'
       WHEN p_size BETWEEN 20 AND 40 THEN 'high' END AS band,
       CASE WHEN p_size > 0 AND p_size <= 10 THEN 'a' WHEN p_size > 10 AND p_size <= 30 THEN 'b' END AS open_cut,
       CASE WHEN p_size >= 1 AND p_size <= 10 THEN 'a' WHEN p_size > 10 AND p_size <= 30 THEN 'b' END AS lowest_cut
FROM part""")
def case_bands(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", R.bands("p_size", [(0, 12, "low"), (15, 22, "mid"), (20, 40, "high")]).alias("band"),
        R.cut("p_size", [0, 10, 30], ["a", "b"]).alias("open_cut"),
        R.cut("p_size", [1, 10, 30], ["a", "b"], include_lowest=True).alias("lowest_cut"),
    )


@query(sql="""
SELECT p_partkey, CASE WHEN p_size NOT IN (7, 13) THEN p_size END AS size, nullif(p_type, 'SMALL') AS type FROM part""")
def sentinel_to_null(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", R.na_if("p_size", 7, 13).alias("size"), R.na_if("p_type", "SMALL").alias("type"))


@query(sql="""
SELECT c_custkey, CASE WHEN x IS NOT NULL THEN greatest(x, 0.0) END AS low, CASE WHEN x IS NOT NULL THEN least(x, 5000.0) END AS high,
       CASE WHEN x >= 0 THEN x END AS positive
FROM (SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal END AS x FROM customer)""")
def clip_guard(spark, d):
    x = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal"))
    return table(spark, d, "customer").select(
        "c_custkey", R.clip_low(x, 0.0).alias("low"), R.clip_high(x, 5000.0).alias("high"),
        R.negative_to_null(x).alias("positive"))


@query(sql="""
SELECT o_orderkey, CASE WHEN x >= 1000 THEN x / 10000 WHEN x > 500 THEN 500.0 ELSE x END AS total_value,
       CASE WHEN x > 50 THEN x / 1000 ELSE x END AS unit_price, CASE WHEN x > 300 THEN x / 1000 ELSE x END AS gift,
       CASE WHEN x > 1000 THEN x / 10000 ELSE x END AS couple_value
FROM (SELECT o_orderkey, o_totalprice / 256 AS x FROM orders)""")
def unit_fix(spark, d):
    x = F.col("o_totalprice") / 256
    return table(spark, d, "orders").select(
        "o_orderkey", R.fix_units(x, codebook.TOTAL_VALUE_RULES).alias("total_value"),
        R.fix_units(x, codebook.UNIT_PRICE_RULES).alias("unit_price"), R.fix_units(x, codebook.GIFT_VALUE_RULES).alias("gift"),
        R.fix_units(x, codebook.COUPLE_VALUE_RULES).alias("couple_value"))


@query(sql="""
SELECT c_custkey, round(CASE WHEN c_acctbal + 50 > 0 THEN ln(c_acctbal + 50) END, 6) AS income_log,
       round(ln(greatest(c_acctbal, 0.0) + 1), 6) AS wealth_log,
       round(exp(ln(greatest(c_acctbal, 0.0) + 1)) - 1, 4) AS back FROM customer""")
def log_shift(spark, d):
    wealth = R.log_shift("c_acctbal", 1, floor=0.0)
    return table(spark, d, "customer").select(
        "c_custkey", F.round(R.log_shift("c_acctbal", 50), 6).alias("income_log"),
        F.round(wealth, 6).alias("wealth_log"), F.round(R.exp_unshift(wealth, 1), 4).alias("back"))


@query(sql="SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 1 ELSE 0 END AS zero_flag FROM customer")
def zero_flag(spark, d):
    return table(spark, d, "customer").select("c_custkey", R.zero_flag("c_acctbal").alias("zero_flag"))


@query(sql="""
SELECT c_custkey, CAST(regexp_extract(c_name, '\\d+') AS DOUBLE) AS number,
       TRY_CAST(nullif(regexp_extract(c_mktsegment, '\\d+'), '') AS DOUBLE) AS nothing FROM customer""")
def extract_number(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", X.extract_number("c_name").alias("number"), X.extract_number("c_mktsegment").alias("nothing"))


@query(sql="""
SELECT o_orderkey, nullif(regexp_replace(o_orderpriority, '[[:punct:][:space:]]', '', 'g'), '') AS o_orderpriority,
       nullif(regexp_replace(o_orderstatus, '[[:punct:][:space:]]', '', 'g'), '') AS o_orderstatus FROM orders""")
def strip_punct(spark, d):
    return X.strip_punct_space(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"))


@query(sql="""
SELECT o_orderkey, o_orderpriority LIKE '%LOW%' AS low, substr(o_orderpriority, 1, 1) AS digit,
       regexp_replace(o_orderpriority, '[0-9]-', '#', 'g') AS swapped, o_orderstatus || '/' || o_orderpriority AS joined,
       coalesce(nullif(o_orderstatus, 'P'), 'NA') || ' ' || o_orderpriority AS pasted FROM orders""")
def text_tools(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", X.str_detect("o_orderpriority", "LOW").alias("low"), X.str_sub("o_orderpriority", 1, 1).alias("digit"),
        X.str_replace_all("o_orderpriority", "[0-9]-", "#").alias("swapped"),
        X.str_c("o_orderstatus", "o_orderpriority", sep="/").alias("joined"),
        X.paste(status(), "o_orderpriority").alias("pasted"))


def line_block(spark, d, slots=range(1, 8)):
    """Line items as a wide block per order: qty1..qty7, price1..price7 (missing where absent). A line number outside the slots is an error."""
    number = F.col("l_linenumber")
    outside = F.raise_error(F.concat(F.lit("line number outside the slots: "), F.coalesce(number.cast("string"), F.lit("missing"))))
    lines = table(spark, d, "lineitem").withColumn("l_linenumber", F.when(number.isin(*slots), number).otherwise(outside.cast("int")))
    aggs = []
    for s in slots:
        mine = F.col("l_linenumber") == s
        aggs += [F.sum(F.when(mine, F.col("l_quantity"))).alias(f"qty{s}"),
                 F.max(F.when(mine, F.col("l_extendedprice"))).alias(f"price{s}"),
                 F.min(F.when(mine, F.col("l_discount"))).alias(f"disc{s}")]
    return lines.groupBy("l_orderkey").agg(*aggs)


BLOCK = "WITH block AS (SELECT l_orderkey, " + ", ".join(
    f"sum(CASE WHEN l_linenumber = {s} THEN l_quantity END) AS qty{s}, "
    f"max(CASE WHEN l_linenumber = {s} THEN l_extendedprice END) AS price{s}, "
    f"min(CASE WHEN l_linenumber = {s} THEN l_discount END) AS disc{s}" for s in range(1, 8)
) + " FROM lineitem GROUP BY l_orderkey) "


@query(sql=BLOCK + """
SELECT l_orderkey, coalesce(qty4, qty3, qty2, qty1) AS newest, coalesce(qty7, qty6, qty5, qty4, qty3, qty2, qty1) AS last FROM block""")
def wave_coalesce(spark, d):
    return line_block(spark, d).select(
        "l_orderkey", R.coalesce_waves("qty4", "qty3", "qty2", "qty1").alias("newest"),
        R.last_present_across(*[f"qty{s}" for s in range(1, 8)]).alias("last"))


@query(sql=BLOCK + """
SELECT l_orderkey, coalesce(price7, price6, price5, price4, price3, price2, price1) AS last_price FROM block""")
def last_present(spark, d):
    return line_block(spark, d).select(
        "l_orderkey", R.last_present_across(*[f"price{s}" for s in range(1, 8)]).alias("last_price"))


@query(sql=BLOCK + """
SELECT l_orderkey, coalesce(qty1, 0) + (coalesce(qty2, 0) + coalesce(qty3, 0)) / 2 AS mid,
       coalesce((qty4 + qty5) / 2, qty4, qty5) AS fallback FROM block""")
def bracket_mid(spark, d):
    return line_block(spark, d).select(
        "l_orderkey", H.bracket_midpoint("qty1", "qty2", "qty3").alias("mid"),
        H.bracket_fallback("qty4", "qty5").alias("fallback"))


@query(sql=BLOCK + """
SELECT l_orderkey, round(coalesce(CASE WHEN qty1 IS NOT NULL
         THEN coalesce(price2, price3 * qty3 / 10, (price4 + price5) / 2 * qty4 / 10000) ELSE price6 END, 0), 4) AS home_value FROM block""")
def property_value(spark, d):
    block = line_block(spark, d)
    # slot 3 holds the area of a unit price, slot 4 that of a bracket: two calls, first hit wins
    by_unit = H.property_value("qty1", "price2", "price3", "qty3", F.lit(None).cast("double"), F.lit(None).cast("double"), "price6")
    by_bracket = H.property_value("qty1", "price2", F.lit(None).cast("double"), "qty4", "price4", "price5", "price6")
    use_unit = F.col("price2").isNotNull() | F.col("price3").isNotNull()
    return block.select("l_orderkey", F.round(F.when(use_unit, by_unit).otherwise(by_bracket), 4).alias("home_value"))


@query(sql=f"""
SELECT o_orderkey, CASE WHEN o_totalprice < 10000 THEN 'tiny' WHEN {STATUS} = 'F' THEN 'done'
       WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE o_orderstatus END AS final FROM orders""")
def mask_ladder(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.mask_ladder(
        "o_orderstatus", (F.col("o_orderpriority") == "5-LOW", "low"), (status() == "F", "done"),
        (F.col("o_totalprice") < 10000, "tiny")).alias("final"))


@query(sql="""
SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '1-URGENT' THEN 3 END AS ordinal,
       CASE o_orderpriority WHEN '5-LOW' THEN 'C' WHEN '3-MEDIUM' THEN 'B' WHEN '1-URGENT' THEN 'A' END AS label FROM orders""")
def level_ordinal(spark, d):
    ordinal = R.level_ordinal("o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"])
    return table(spark, d, "orders").select(
        "o_orderkey", ordinal.alias("ordinal"), R.ordinal_label(ordinal, ["C", "B", "A"]).alias("label"))


@query(sql=BLOCK + "SELECT l_orderkey, coalesce(qty5, 0) AS qty5, coalesce(price5, -1) AS price5 FROM block")
def replace_na(spark, d):
    return line_block(spark, d).select(
        "l_orderkey", R.replace_na("qty5", 0.0).alias("qty5"), R.replace_na("price5", -1.0).alias("price5"))


@query(sql=BLOCK + "SELECT l_orderkey, coalesce(qty2, qty3) AS hi, coalesce(qty3, qty2) AS lo FROM block")
def pair_fill(spark, d):
    hi, lo = R.coalesce_pair("qty2", "qty3")
    return line_block(spark, d).select("l_orderkey", hi.alias("hi"), lo.alias("lo"))


@query(sql=f"""
SELECT o_orderkey, CASE WHEN {STATUS} IN ('O') THEN o_orderpriority WHEN NOT ({STATUS} IN ('O')) THEN {STATUS} END AS resolved FROM orders""")
def resolve_pair(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", R.resolve_pair(status(), "o_orderpriority", ["O"]).alias("resolved"))


@query(sql="""
SELECT n_nationkey, n_name, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'tier ' || r_name ELSE 'lowest' END AS tier
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def tier_of(spark, d):
    listed = table(spark, d, "region").filter(F.col("r_name").isin("ASIA", "EUROPE"))
    codes = table(spark, d, "nation").join(listed, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("city"), F.concat(F.lit("tier "), "r_name").alias("tier"))
    return link.tier_of(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", codes, "lowest")


@query(sql="""
SELECT o_orderkey, TRY_CAST(o_orderpriority AS DOUBLE) AS o_orderpriority, TRY_CAST(o_orderstatus AS DOUBLE) AS o_orderstatus,
       CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS digit FROM orders""")
def cast_all(spark, d):
    digits = table(spark, d, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("digit"))
    return shape.cast_all(digits, ["o_orderpriority", "o_orderstatus", "digit"], "double")


@query(sql=f"SELECT o_orderkey, CASE WHEN coalesce({STATUS} IN ('F'), false) THEN 'close' ELSE 'other' END AS distance FROM orders")
def dichotomy(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.dichotomy(status(), ["F"], "close", "other").alias("distance"))


@query(sql=f"""
SELECT o_orderkey, CASE WHEN {STATUS} = 'O' THEN NULL ELSE o_totalprice END AS prior_value,
       CASE WHEN {STATUS} = 'F' THEN o_totalprice WHEN {STATUS} <> 'F' THEN 0.0 END AS gift FROM orders""")
def reset_if(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", R.house_reset_if_moved(status() == "O", "o_totalprice").alias("prior_value"),
        R.conditional_zero(status() == "F", "o_totalprice").alias("gift"))


@query(sql="""
SELECT o_orderkey, 2018 - CAST(year(o_orderdate) AS INTEGER) AS age,
       CAST(year(o_orderdate) AS INTEGER) - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS gap FROM orders""")
def age_gap(spark, d):
    year = F.year("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", R.age_at(2018, year).alias("age"),
        R.year_gap(year.cast("string"), F.substring("o_orderpriority", 1, 1)).alias("gap"))


@query(sql=f"""
SELECT o_orderkey, round(o_totalprice / 10000, 8) AS in_10k, 6 - {PRIO_NO} AS reversed, {STATUS} = 'F' AS finished FROM orders""")
def scale_reverse_flag(spark, d):
    prio = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(R.scale_units("o_totalprice", 1 / 10000), 8).alias("in_10k"),
        R.reverse_code(prio, 5).alias("reversed"), R.flag_equals(status(), "F").alias("finished"))


@query(sql=BLOCK + """
SELECT l_orderkey, round(coalesce(price1, 0) + coalesce(price2, 0) + coalesce(price3, 0) - coalesce(price4, 0), 4) AS net FROM block""")
def net_worth(spark, d):
    return line_block(spark, d).select(
        "l_orderkey", F.round(R.net_worth(["price1", "price2", "price3"], ["price4"]), 4).alias("net"))


@query(sql="SELECT o_orderkey, round(o_totalprice / 1000, 1) AS k FROM orders")
def round_report(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.round_report(F.col("o_totalprice") / 1000, 1).alias("k"))


@query(sql=f"""
SELECT o_orderkey, CASE WHEN {STATUS} = 'F' THEN o_orderpriority WHEN {STATUS} <> 'F' THEN o_clerk END AS who_husb,
       CASE WHEN {STATUS} = 'F' THEN o_clerk WHEN {STATUS} <> 'F' THEN o_orderpriority END AS who_wife
FROM (SELECT *, CAST(o_custkey AS VARCHAR) AS o_clerk FROM orders)""")
def swap_roles(spark, d):
    couples = table(spark, d, "orders").withColumns(
        {"who_res": F.col("o_orderpriority"), "who_sps": F.col("o_custkey").cast("string")})
    return shape.transmute(couples, o_orderkey=F.col("o_orderkey"), **H.swap_roles(status() == "F", ["who"]))


@query(sql="""
SELECT user_id,
       CASE WHEN count(CASE WHEN event_type = 'click' THEN 1 END) > 0
            THEN bool_or(event_type = 'click' AND value >= 30) END AS click_key,
       CASE WHEN count(CASE WHEN event_type = 'signup' THEN 1 END) > 0
            THEN bool_or(event_type = 'signup' AND value >= 30) END AS signup_key
FROM events GROUP BY user_id""")
def episode_flags(spark, d):
    # episodes of a person: the distinct (kind, school) pairs, two schools per kind at most
    school = F.when(F.col("value") >= 30, "key").otherwise("plain")
    people = table(spark, d, "events").groupBy("user_id").agg(
        F.collect_set(F.struct(F.col("event_type").alias("kind"), school.alias("school"))).alias("episodes"))
    return people.select("user_id", H.episode_flags(F.col("episodes"), ["click"], ["key"]).alias("click_key"),
                         H.episode_flags(F.col("episodes"), ["signup"], ["key"]).alias("signup_key"))


@query(sql="""
SELECT p_partkey, CASE WHEN f IS NOT NULL THEN f WHEN p_size < 6 THEN 'dropout' END AS primary_,
       CASE WHEN f IS NOT NULL THEN f WHEN p_size <= 6 THEN 'dropout' END AS middle,
       CASE WHEN f IS NOT NULL THEN f WHEN p_size <= 9 THEN 'dropout' WHEN p_size = 11 THEN 'FALSE' END AS high,
       CASE WHEN f IS NOT NULL THEN f WHEN p_size <= 12 THEN 'dropout' END AS college
FROM (SELECT *, CASE WHEN p_type = 'ECONOMY' THEN 'TRUE' WHEN p_type = 'SMALL' THEN 'FALSE' END AS f FROM part)""")
def dropout_fill(spark, d):
    flag = R.case_when((F.col("p_type") == "ECONOMY", "TRUE"), (F.col("p_type") == "SMALL", "FALSE"))
    return table(spark, d, "part").select("p_partkey", *[
        H.dropout_fill(flag, "p_size", level).alias(name)
        for level, name in [("primary", "primary_"), ("middle", "middle"), ("high", "high"), ("college", "college")]])


@query(sql="""
SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN status = '3' THEN
         CASE WHEN sector IN ('1', '2', '3', '4', '5', '7') THEN 'Public' WHEN sector IN ('8', '9') THEN 'Private'
              WHEN owner IN ('1', '2') THEN 'Public' ELSE 'Private' END ELSE 'Private' END AS class
FROM (SELECT *, CAST(l_linenumber % 4 AS VARCHAR) AS status, CAST(CAST(l_quantity AS INTEGER) % 12 AS VARCHAR) AS sector,
      CAST(l_suppkey % 4 AS VARCHAR) AS owner FROM lineitem)""")
def employment_class(spark, d):
    text = lambda x: x.cast("string")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", H.employment_class(
        text(F.col("l_linenumber") % 4), text(F.col("l_quantity").cast("int") % 12), text(F.col("l_suppkey") % 4)).alias("class"))


@query(sql=f"""
SELECT o_orderkey, CASE WHEN coalesce({STATUS} = 'F', false) THEN CASE WHEN o_orderpriority = '1-URGENT'
       THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END ELSE {STATUS} END AS job FROM orders""")
def job_cascade(spark, d):
    return table(spark, d, "orders").select("o_orderkey", H.job_detail_cascade(
        status(), "o_orderpriority", F.col("o_custkey").cast("string"), ["F"], ["1-URGENT"]).alias("job"))


@query(sql="""
SELECT event_id, CASE WHEN event_type = 'click' THEN value * 12 WHEN event_type = 'view' THEN event_id * 12.0
       WHEN event_type = 'error' THEN 0.0 END AS pay FROM events""")
def annualise(spark, d):
    return table(spark, d, "events").select("event_id", H.annualise(
        "event_type", {"click": "value", "view": F.col("event_id").cast("double")}, unpaid=["error"]).alias("pay"))


@query(sql="""
SELECT event_id, CASE event_type WHEN 'click' THEN 'AG' WHEN 'view' THEN 'IN' ELSE 'OUT' END AS state FROM events""")
def classify_state(spark, d):
    return table(spark, d, "events").select(
        "event_id", H.classify_state("event_type", {"click": "AG", "view": "IN"}, "OUT").alias("state"))


_QBIN = """
WITH q AS (SELECT quantile_cont(c_acctbal, 0) b0, quantile_cont(c_acctbal, 0.25) b1, quantile_cont(c_acctbal, 0.5) b2,
                  quantile_cont(c_acctbal, 0.75) b3, quantile_cont(c_acctbal, 1) b4 FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal {} b0 AND c_acctbal <= b1 THEN '0-25%' WHEN c_acctbal > b1 AND c_acctbal <= b2 THEN '25-50%'
       WHEN c_acctbal > b2 AND c_acctbal <= b3 THEN '50-75%' WHEN c_acctbal > b3 AND c_acctbal <= b4 THEN '75-100%' END AS bin
FROM customer, q"""
QUARTERS = [0, 0.25, 0.5, 0.75, 1]
QUARTER_LABELS = ["0-25%", "25-50%", "50-75%", "75-100%"]


@query(sql=_QBIN.format(">="))
def quantile_bin_lowest(spark, d):
    people = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return quantile_bin(people, "c_acctbal", QUARTERS, QUARTER_LABELS).drop("c_acctbal")


@query(sql=_QBIN.format(">"))
def quantile_bin_open(spark, d):
    people = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return quantile_bin(people, "c_acctbal", QUARTERS, QUARTER_LABELS, include_lowest=False).drop("c_acctbal")
