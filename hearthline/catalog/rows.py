"""Column shaping, filters, reshape, aggregates, picks and sorts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.catalog import query, table
from hearthline.catalog.scalars import BLOCK, STATUS, line_block, status
from hearthline.functions import household as H, recode as R
from hearthline.operators import household as HH, predicates as P, shape as S
from hearthline.session import shared_folder
from hearthline.sources import labelled, tables as ST

# --- column shaping -------------------------------------------------------------------------


@query(sql="SELECT p_partkey AS id, p_brand AS brand, p_size AS size FROM part")
def select_rename(spark, d):
    return S.select_rename(table(spark, d, "part"), {"id": "p_partkey", "brand": "p_brand", "size": "p_size"})


@query(sql="SELECT p_partkey, p_brand, p_type, p_size FROM part")
def col_range(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", *S.col_range(part, "p_brand", "p_size"))


@query(sql=BLOCK + "SELECT l_orderkey, qty1, qty2, qty3, qty4, qty5, qty6, qty7 FROM block")
def cols_matching(spark, d):
    block = line_block(spark, d)
    return block.select("l_orderkey", *S.cols_matching(block, r"^qty\d+$"))


@query(sql="SELECT c_custkey, c_name, c_nationkey FROM customer")
def drop_cols(spark, d):
    people = table(spark, d, "customer")
    return S.drop_cols(people, *S.col_setdiff(people.columns, ["c_custkey", "c_name", "c_nationkey"]))


@query(sql=BLOCK + """SELECT l_orderkey, round(ln(price1 + 50), 6) AS price1_logged, round(ln(price2 + 50), 6) AS price2_logged FROM block""")
def mutate_at_log(spark, d):
    logged = S.mutate_at(line_block(spark, d), ["price1", "price2"], lambda x: F.round(R.log_shift(x, 50), 6), "_logged")
    return logged.select("l_orderkey", "price1_logged", "price2_logged")


@query(sql="""SELECT p_partkey, lower(p_name) AS p_name, lower(p_brand) AS p_brand, lower(p_type) AS p_type, p_size,
round(p_retailprice * 2, 2) AS p_retailprice FROM part""")
def mutate_by_type(spark, d):
    text = S.mutate_if(table(spark, d, "part"), T.StringType, F.lower)
    return S.mutate_if(text, T.DoubleType, lambda x: F.round(x * 2, 2))


@query(sql="SELECT c_custkey, c_name AS c_name_parent, c_acctbal AS c_acctbal_parent FROM customer")
def suffix_cols(spark, d):
    return S.suffix_cols(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "_parent", ["c_custkey"])


@query(sql="SELECT p_size, p_type, p_partkey, p_name, p_brand, p_retailprice FROM part")
def reorder(spark, d):
    return S.reorder_cols(table(spark, d, "part"), ["p_size", "p_type"])


@query(sql="SELECT p_partkey, p_size * 2 AS double_size, p_brand || p_type AS kind FROM part")
def transmute(spark, d):
    part = S.mutate(table(spark, d, "part"), double_size=F.col("p_size") * 2)
    return S.transmute(part, p_partkey=F.col("p_partkey"), double_size=F.col("double_size"), kind=F.concat("p_brand", "p_type"))


@query(sql="SELECT c_custkey, c_name, c_acctbal FROM customer")
def bind_by_key(spark, d):
    people = table(spark, d, "customer")
    return S.bind_cols_by_key(people.select("c_custkey", "c_name"), people.select("c_custkey", "c_acctbal"), ["c_custkey"])


@query(sql="SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 6")
def head_n(spark, d):
    return S.head(table(spark, d, "part").select("p_partkey", "p_name"), order=[F.col("p_partkey")])


# --- reshape --------------------------------------------------------------------------------


@query(sql=BLOCK + """
SELECT l_orderkey, 'qty' || s AS key, CASE s WHEN 1 THEN qty1 WHEN 2 THEN qty2 WHEN 7 THEN qty7 END AS value, CAST(s AS INTEGER) AS slot
FROM block, (VALUES (1), (2), (7), (9)) v(s)""")
def ensure_and_unpivot(spark, d):
    wide = S.ensure_cols(line_block(spark, d), {"qty1": "double", "qty9": "double"})
    return S.unpivot(wide, ["l_orderkey"], ["qty1", "qty2", "qty7", "qty9"]).withColumn("slot", S.slot_from_name("key"))


@query(sql="""
SELECT l_orderkey, l_linenumber AS slot, sum(l_quantity) AS qty, max(l_extendedprice) AS price, min(l_discount) AS disc
FROM lineitem GROUP BY 1, 2""")
def unpivot_blocks(spark, d):
    return S.unpivot_blocks(line_block(spark, d), ["l_orderkey"], {"qty": "qty{}", "price": "price{}", "disc": "disc{}"}, range(1, 17))


@query(sql="SELECT l_orderkey, l_linenumber AS slot, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2")
def array_block_rows(spark, d):
    return S.array_block_to_rows(line_block(spark, d), ["l_orderkey"], "qty{}", range(1, 19), "qty")


@query(sql="""
SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS F, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS O,
       count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS P FROM orders GROUP BY 1""")
def pivot_counts(spark, d):
    return S.pivot_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(sql="""
SELECT CAST(c_custkey AS BIGINT) AS id, c_acctbal AS wealth, 'A' AS panel, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, 'B', NULL FROM supplier""")
def union_panels(spark, d):
    a = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("wealth"), F.lit("A").alias("panel"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.lit("B").alias("panel"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("wealth"))
    return S.union_all(a, b)


@query(sql="""
SELECT o_orderpriority AS grp, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1
UNION ALL SELECT 'other panel', count(*), round(avg(s_acctbal) * 1.67, 4) FROM supplier
UNION ALL SELECT 'none', 0, NULL""")
def summary_row(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    extra = table(spark, d, "supplier").agg(
        F.lit("other panel").alias("grp"), F.count(F.lit(1)).alias("n"), F.round(F.avg("s_acctbal") * 1.67, 4).alias("mean"))
    return S.append_summary_row(S.append_summary_row(rows, extra), {"grp": "none", "n": 0})


@query(sql="""
SELECT a.o_orderpriority, a.n AS done_n, a.total AS done_total, b.n AS open_n, b.total AS open_total
FROM (SELECT o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
FULL JOIN (SELECT o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b
ON a.o_orderpriority = b.o_orderpriority""")
def side_by_side(spark, d):
    part = lambda s: table(spark, d, "orders").filter(F.col("o_orderstatus") == s).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return S.bind_tables_side_by_side({"done": part("F"), "open": part("O")}, ["o_orderpriority"])


# --- filters --------------------------------------------------------------------------------


@query(sql=BLOCK + "SELECT l_orderkey, qty1, qty2, qty3 FROM block WHERE qty1 IS NOT NULL AND qty2 IS NOT NULL AND qty3 IS NOT NULL")
def drop_incomplete(spark, d):
    return S.drop_incomplete(line_block(spark, d).select("l_orderkey", "qty1", "qty2", "qty3"))


@query(sql=BLOCK + "SELECT l_orderkey, qty6, qty7 FROM block WHERE qty6 IS NOT NULL OR qty7 IS NOT NULL")
def any_present(spark, d):
    return S.keep_if_any_present(line_block(spark, d).select("l_orderkey", "qty6", "qty7"), ["qty6", "qty7"])


@query(sql=f"""
SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 23000 AND 250000 AND {STATUS} IS NOT NULL""")
def filter_conj(spark, d):
    conditions = [R.in_set("o_orderpriority", ["1-URGENT", "2-HIGH"]), F.col("o_totalprice").between(23000, 250000), R.not_missing(status())]
    return P.filter_all(table(spark, d, "orders"), conditions).select("o_orderkey")


@query(sql=f"SELECT o_orderkey, {STATUS} AS st FROM orders WHERE {STATUS} IS NULL OR {STATUS} <> 'F'")
def not_in_keep_null(spark, d):
    return table(spark, d, "orders").filter(R.not_in_set(status(), ["F"])).select("o_orderkey", status().alias("st"))


@query(sql=f"SELECT o_orderkey, {STATUS} IS NULL AS gone FROM orders WHERE {STATUS} IS NULL OR o_totalprice > 100000")
def missing_pred(spark, d):
    rows = table(spark, d, "orders").filter(R.is_missing(status()) | (F.col("o_totalprice") > 100000))
    return rows.select("o_orderkey", R.is_missing(status()).alias("gone"))


@query(sql="""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)""")
def min_group(spark, d):
    return P.group_size_filter(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 12)


@query(sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def subpopulation(spark, d):
    married = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)
    return P.subpopulation(table(spark, d, "orders"), married).select("o_orderkey", "o_totalprice")


# --- aggregates -----------------------------------------------------------------------------


@query(sql=f"""
SELECT o_custkey, coalesce(round(sum(CASE WHEN {STATUS} = 'F' THEN o_totalprice END), 2), 0) AS x FROM orders GROUP BY 1""")
def hh_sum(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.when(status() == "F", F.col("o_totalprice")).alias("x"))
    return HH.group_sum(rows, ["o_custkey"], ["x"]).withColumn("x", F.round("x", 2))


@query(sql=f"""
SELECT {STATUS} AS st, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders
WHERE {STATUS} IS NOT NULL GROUP BY 1, 2""")
def group_mean_n(spark, d):
    cells = HH.group_mean_n(table(spark, d, "orders").withColumn("st", status()), ["st", "o_orderpriority"], "o_totalprice")
    return cells.withColumn("mean", F.round("mean", 4))


@query(sql=f"""
SELECT o_custkey, CASE WHEN count(x) = count(*) THEN round(avg(x), 8) END AS x
FROM (SELECT o_custkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS x FROM orders) GROUP BY 1""")
def strict_mean(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("x"))
    return HH.group_mean_strict(rows, ["o_custkey"], ["x"]).withColumn("x", F.round("x", 8))


@query(sql="""
SELECT o_orderpriority, round(median(o_totalprice * 10000) , 2) AS median FROM orders GROUP BY 1""")
def group_median(spark, d):
    medians = HH.group_median(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 10000)
    return medians.withColumn("median", F.round("median", 2))


@query(sql="""
SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price, round(avg(CAST(year(o_orderdate) AS DOUBLE)), 2) AS mean_year,
       round(count(*) / (SELECT count(*) FROM orders), 2) AS share FROM orders GROUP BY 1 HAVING count(*) > 100""")
def group_profile(spark, d):
    metrics = {"mean_price": F.avg("o_totalprice"), "mean_year": F.avg(F.year("o_orderdate"))}
    return HH.group_profile(table(spark, d, "orders"), ["o_orderpriority"], metrics, min_n=100)


@query(sql=BLOCK + """
SELECT l_orderkey, round(10000 * (coalesce(price1, 0) + coalesce(price2, 0) + coalesce(price3, 0)), 0) AS wealth, price1 + price2 AS strict,
       CASE WHEN price1 > 0 THEN 1 ELSE 0 END + CASE WHEN price2 > 50000 THEN 1 ELSE 0 END + CASE WHEN price7 > 0 THEN 1 ELSE 0 END AS homes,
       round(coalesce(qty1, 0) + 12 * coalesce(qty2, 0) - coalesce(qty3, 0), 4) AS consumption FROM block""")
def row_sums(spark, d):
    return line_block(spark, d).select(
        "l_orderkey", F.round(R.scale_units(R.row_sum("price1", "price2", "price3", na_zero=True), 10000), 0).alias("wealth"),
        R.row_sum("price1", "price2").alias("strict"),
        R.row_count_positive("price1", F.col("price2") - 50000, "price7").alias("homes"),
        F.round(R.weighted_row_sum({"qty1": 1, "qty2": 12, "qty3": -1}), 4).alias("consumption"))


@query(sql=f"SELECT {STATUS} AS st, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def count_by(spark, d):
    return HH.count_by(table(spark, d, "orders").withColumn("st", status()), "st", "o_orderpriority")


@query(sql="SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def distinct_keys(spark, d):
    return HH.distinct_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query(sql=f"""
SELECT {STATUS} IS NULL AS missing, count(*) AS n, round(avg(o_totalprice), 4) AS mean_o_totalprice, round(avg(o_custkey), 4) AS mean_o_custkey
FROM orders GROUP BY 1""")
def mean_by_missing(spark, d):
    rows = table(spark, d, "orders").withColumn("st", status())
    return S.mutate_at(HH.mean_by_missing(rows, "st", ["o_totalprice", "o_custkey"]), ["mean_o_totalprice", "mean_o_custkey"], lambda x: F.round(x, 4))


@query(sql="SELECT count(*) AS n FROM lineitem")
def table_total(spark, d):
    return HH.row_total(table(spark, d, "lineitem"))


# --- windows and picks ----------------------------------------------------------------------


@query(sql="""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS sibling_rank FROM orders""")
def sibling_rank(spark, d):
    children = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    ranked = HH.sibling_rank(children, ["o_custkey"], [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")])
    return ranked.select("o_orderkey", "sibling_rank")


@query(sql="SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def group_size(spark, d):
    return HH.group_size_col(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"]).select("o_orderkey", "n")


@query(sql="""
SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def householder(spark, d):
    people = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return HH.householder(people, ["o_custkey"], "o_orderpriority", ["3-MEDIUM", "1-URGENT"], "o_orderkey")


@query(sql="""
WITH g AS (SELECT o_custkey, o_orderkey, 1998 - CAST(year(o_orderdate) AS INTEGER) AS gap FROM orders),
     m AS (SELECT o_custkey, min(CASE WHEN gap > 0 THEN gap END) AS best FROM g GROUP BY 1)
SELECT m.o_custkey, coalesce(CASE WHEN count(CASE WHEN g.gap = best THEN 1 END) = 1 THEN min(CASE WHEN g.gap = best THEN CAST(o_orderkey AS VARCHAR) END) END, '1') AS slot
FROM m JOIN g ON m.o_custkey = g.o_custkey GROUP BY 1""")
def nearest_before(spark, d):
    jobs = table(spark, d, "orders").withColumn("slot", F.col("o_orderkey"))
    return HH.nearest_before(jobs, ["o_custkey"], F.lit(1998) - F.year("o_orderdate"), "slot")


@query(sql=BLOCK + """
, g AS (SELECT l_orderkey, s, CASE s WHEN 1 THEN 40 - qty1 WHEN 2 THEN 40 - qty2 WHEN 3 THEN 40 - qty3 WHEN 4 THEN 40 - qty4 END AS gap FROM block, (VALUES (1), (2), (3), (4)) v(s)),
  m AS (SELECT *, min(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY l_orderkey) AS best FROM g)
SELECT l_orderkey, coalesce(CASE WHEN count(CASE WHEN gap = best THEN 1 END) = 1 THEN max(CASE WHEN gap = best THEN CAST(s AS VARCHAR) END) END, '1') AS slot FROM m GROUP BY 1""")
def nearest_before_wide(spark, d):
    slots = [(str(s), F.col(f"qty{s}")) for s in range(1, 5)]
    return line_block(spark, d).select("l_orderkey", H.nearest_before_slot(slots, F.lit(40)).alias("slot"))


@query(sql="""
SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN 'only child' WHEN l_linenumber = 1 THEN 'first child' ELSE 'later child' END AS position
FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))""")
def birth_position(spark, d):
    children = HH.distinct_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")
    sized = HH.group_size_col(children, ["l_orderkey"])
    return sized.select("l_orderkey", "l_linenumber", H.birth_position("n", "l_linenumber").alias("position"))


@query(sql="""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('1:' || o_orderkey), o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def sample_one(spark, d):
    children = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return HH.sample_one(children, ["o_custkey"], ["o_orderkey"], seed=1)


@query(sql="""
SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events""")
def spell_lead(spark, d):
    changes = table(spark, d, "events").select("event_id", "user_id", "ts")
    return HH.spell_to_next(changes, ["user_id"], [F.col("ts"), F.col("event_id")], "event_id", "next_id").drop("ts")


@query(sql=f"""
SELECT o_orderkey, st, row_number() OVER (ORDER BY st DESC NULLS LAST, o_orderkey) AS place FROM (SELECT o_orderkey, {STATUS} AS st FROM orders)
ORDER BY place""")
def sort_nulls_last(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", status().alias("st"))
    placed = HH.sibling_rank(rows, [], [F.col("st").desc_nulls_last(), F.col("o_orderkey")], "place")
    return HH.arrange(placed, ("st", "desc"), ("o_orderkey", "asc"))


@query(sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def top1(spark, d):
    return HH.top1(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query(sql="SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1")
def top_value(spark, d):
    return HH.top_value(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "top")


# --- files ----------------------------------------------------------------------------------


def scratch(spark, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(sql="SELECT p_partkey, p_brand, p_size FROM part")
def parquet_roundtrip(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return ST.checkpoint_table(part, scratch(spark, "parquet"))


@query(sql="SELECT n_nationkey, '省' || n_name AS n_name FROM nation")
def csv_encoding_roundtrip(spark, d):
    path = scratch(spark, "gb2312")
    rows = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("省"), "n_name").alias("n_name"))
    # the allow-list of charsets is a session setting; put it back afterwards
    before = spark.conf.get("spark.sql.legacy.javaCharsets", "false")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        rows.write.option("header", True).option("encoding", "GB2312").csv(path)
        back = labelled.read_raw_codes(spark, path, "n_nationkey int, n_name string")
        return ST.checkpoint_table(back, scratch(spark, "gb2312-decoded"))
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", before)


@query(sql="SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def report_csv(spark, d):
    path = scratch(spark, "report")
    ST.write_report_csv(HH.count_by(table(spark, d, "orders"), "o_orderpriority"), path)
    return labelled.read_extract(spark, path, "o_orderpriority string, n bigint", "csv")


@query(sql="""SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, regexp_replace(n_name, '[[:punct:][:space:]]', '', 'g') AS n_name,
CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation""")
def spss_extract(spark, d):
    return labelled.read_spss_extract(spark, f"{d}/nation.parquet")


@query(sql="SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def code_list_file(spark, d):
    path = scratch(spark, "codes")
    names = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ST.write_report_csv(names.select(F.col("r_name").alias("list"), F.col("n_name").alias("value")), path)
    listed = labelled.code_list_values(labelled.read_code_list(spark, path), "ASIA").withColumnRenamed("value", "n_name")
    people = labelled.decode_labels(
        table(spark, d, "customer"),
        table(spark, d, "nation").select(F.lit("c_nationkey").alias("col"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label")),
        ["c_nationkey"]).withColumnRenamed("c_nationkey", "n_name")
    return P.member_filter(people, listed, ["n_name"]).select("c_custkey")


@query(sql="SELECT row_number() OVER (ORDER BY label) AS ordinal, label FROM (SELECT DISTINCT o_orderpriority AS label FROM orders)")
def level_dictionary(spark, d):
    return labelled.levels_of(table(spark, d, "orders"), "o_orderpriority")
