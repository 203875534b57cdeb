"""Joins: customers as households, orders as children, nations as communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.catalog import query, table
from hearthline.catalog.scalars import BLOCK, STATUS, line_block, status
from hearthline.functions import recode as R
from hearthline.operators import household as HH, link, shape
from hearthline.operators.predicates import member_filter


def year():
    return F.year("o_orderdate")


@query(sql="""
SELECT c_custkey, c_mktsegment, n_orders, largest, f_price
FROM customer LEFT JOIN (SELECT o_custkey, count(*) n_orders, max(o_totalprice) largest FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) f_price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def person_attr_join(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    counts = orders.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("largest"))
    done = orders.filter(F.col("o_orderstatus") == "F").groupBy("c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("f_price"))
    return link.person_attr_join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), [counts, done], ["c_custkey"])


@query(sql="""
WITH a AS (SELECT o_custkey AS hhid, max(o_totalprice) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
     b AS (SELECT o_custkey AS hhid, max(o_totalprice) AS o FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000 GROUP BY 1),
     c AS (SELECT c_custkey AS hhid, c_acctbal AS debt FROM customer WHERE c_acctbal < 0)
SELECT coalesce(a.hhid, b.hhid, c.hhid) AS hhid, f, o, debt
FROM a FULL JOIN b ON a.hhid = b.hhid FULL JOIN c ON coalesce(a.hhid, b.hhid) = c.hhid""")
def hh_full_join(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "hhid")
    best = lambda cond, n: orders.filter(cond).groupBy("hhid").agg(F.max("o_totalprice").alias(n))
    debts = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("hhid"), F.col("c_acctbal").alias("debt"))
    return link.full_join([best(F.col("o_orderstatus") == "F", "f"),
                           best((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 300000), "o"), debts], ["hhid"])


@query(sql="""
SELECT a.*, b.taxed FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2) a
LEFT JOIN (SELECT l_orderkey, l_linenumber, max(l_tax) AS taxed FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def child_two_key_join(spark, d):
    keys, lines = ["l_orderkey", "l_linenumber"], table(spark, d, "lineitem")
    base = lines.groupBy(*keys).agg(F.sum("l_quantity").alias("qty"))
    gifts = lines.filter(F.col("l_returnflag") == "R").groupBy(*keys).agg(F.max("l_tax").alias("taxed"))
    return link.left_join(base, gifts, keys, hot=[])  # one row per key


@query(sql="""
WITH w1 AS (SELECT o_custkey, max(o_totalprice) AS earlier FROM orders WHERE year(o_orderdate) <= 1996 GROUP BY 1),
     w2 AS (SELECT o_custkey, max(o_totalprice) AS current FROM orders WHERE year(o_orderdate) >= 1999 GROUP BY 1)
SELECT w2.o_custkey, earlier, current FROM w1 RIGHT JOIN w2 ON w1.o_custkey = w2.o_custkey""")
def right_wave_join(spark, d):
    orders = table(spark, d, "orders")
    wave = lambda cond, n: orders.filter(cond).groupBy("o_custkey").agg(F.max("o_totalprice").alias(n))
    return link.right_join(wave(year() <= 1996, "earlier"), wave(year() >= 1999, "current"), ["o_custkey"], hot=[])


@query(sql="""
SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000""")
def inner_head_join(spark, d):
    heads = table(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_mktsegment")
    children = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return link.inner_join(children, heads, ["c_custkey"])


@query(sql="""
SELECT c_custkey, n_name, coalesce(CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN r_regionkey + CAST(0.5 AS DOUBLE) END, CAST(0.3 AS DOUBLE)) AS price
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def dim_default_join(spark, d):
    region = table(spark, d, "region").filter(F.col("r_name").isin("ASIA", "EUROPE")).select(
        F.col("r_regionkey").alias("n_regionkey"), (F.col("r_regionkey") + F.lit(0.5)).alias("price"))
    places = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    people = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(places, "c_nationkey")
    return link.dim_join(people, region, ["n_regionkey"], {"price": 0.3}).select("c_custkey", "n_name", "price")


@query(sql="""
SELECT c_custkey, o_orderpriority, o_orderkey FROM customer LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) AS rn
  FROM orders WHERE o_orderpriority IN ('2-HIGH', '5-LOW')) ON o_custkey = c_custkey AND rn = 1""")
def preferred_match(spark, d):
    addresses = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return link.preferred_match_join(table(spark, d, "customer").select("c_custkey"), addresses, ["c_custkey"],
                                     "o_orderpriority", ["2-HIGH", "5-LOW"], hot=[])


@query(sql="""
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def semi_member(spark, d):
    rich = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return member_filter(table(spark, d, "customer").select("c_custkey", "c_name"), rich, ["c_custkey"])


@query(sql=f"""
SELECT o_orderkey, CASE WHEN {STATUS} = 'F' THEN c_mktsegment ELSE o_orderpriority END AS lives_in
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def fill_from_related(spark, d):
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("place"))
    merged = link.parent_child_merge(table(spark, d, "orders"), parents, ["o_custkey"])
    return merged.select("o_orderkey", R.fill_from_related(status() == "F", "place_parent", "o_orderpriority").alias("lives_in"))


@query(sql="""
SELECT o_orderkey, o_custkey, c_mktsegment AS seg_parent, c_acctbal AS bal_parent FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal >= 0""")
def parent_child_merge(spark, d):
    parents = table(spark, d, "customer").filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    return link.parent_child_merge(table(spark, d, "orders").select("o_orderkey", "o_custkey"), parents, ["o_custkey"])


@query(sql="SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def natural_left_join(spark, d):
    return link.natural_left_join(table(spark, d, "nation"), table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"))


@query(sql=f"""
WITH o AS (SELECT o_orderkey, {STATUS} AS st FROM orders), s AS (SELECT {STATUS} AS st, count(*) AS size FROM orders GROUP BY 1)
SELECT o_orderkey, o.st, size FROM o LEFT JOIN s ON o.st IS NOT DISTINCT FROM s.st""")
def missing_key_join(spark, d):
    people = table(spark, d, "orders").select("o_orderkey", status().alias("st"))
    return link.left_join(people, people.groupBy("st").agg(F.count(F.lit(1)).alias("size")), ["st"], missing_keys_match=True)


@query(sql=BLOCK + """
SELECT l_orderkey, CAST(l_orderkey % 9 AS INTEGER) AS slot,
       CASE l_orderkey % 9 WHEN 1 THEN qty1 WHEN 2 THEN qty2 WHEN 3 THEN qty3 WHEN 4 THEN qty4 WHEN 5 THEN qty5 WHEN 6 THEN qty6 WHEN 7 THEN qty7 END AS qty FROM block""")
def slot_lookup(spark, d):
    slot = (F.col("l_orderkey") % 9).cast("int")
    return line_block(spark, d).select(
        "l_orderkey", slot.alias("slot"), shape.slot_lookup(slot, {s: f"qty{s}" for s in range(1, 8)}).alias("qty"))


@query(sql="""
SELECT o_orderkey, CAST(o_orderkey % 9 AS INTEGER) AS slot, qty FROM orders LEFT JOIN
  (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey AND l_linenumber = o_orderkey % 9""")
def slot_lookup_join(spark, d):
    slots = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("slot")).agg(
        F.sum("l_quantity").alias("qty"))
    wanted = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 9).cast("int").alias("slot"))
    return link.slot_lookup_join(wanted, slots, ["o_orderkey"], "slot", hot=[])  # one row per order


# --- spells and windows ---------------------------------------------------------------------

SPELLS = """
WITH spells AS (SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS s,
                CAST(year(o_orderdate) + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS INTEGER) AS e FROM orders) """


def order_spells(spark, d):
    """Each order a spell of its customer: from its year on, as long as its priority says."""
    s = F.year("o_orderdate")
    return table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", s.alias("s"), (s + F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("e"))


@query(sql=SPELLS + """
SELECT o_orderkey, greatest(0, least(e, w + 2) - greatest(s, w) + 1) AS overlap, greatest(0, least(e, 1998) - greatest(s, 1996) + 1) AS fixed
FROM spells JOIN (SELECT c_custkey, 1996 + c_nationkey % 3 AS w FROM customer) ON o_custkey = c_custkey""")
def interval_overlap(spark, d):
    start = F.lit(1996) + F.col("c_nationkey") % 3
    windows = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), start.alias("ws"), (start + 2).alias("we"))
    spells = link.overlap_with_fixed(order_spells(spark, d), ("s", "e"), 1996, 1998, "fixed")
    return link.interval_overlap_join(spells, windows, ["o_custkey"], ("s", "e"), ("ws", "we")).select("o_orderkey", "overlap", "fixed")


@query(sql=SPELLS + """, o AS (SELECT *, greatest(0, least(e, 1999) - greatest(s, 1998) + 1) AS overlap FROM spells)
SELECT o_custkey, o_orderkey, overlap FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY overlap DESC,
       CASE WHEN overlap > 0 THEN 0 ELSE e END, o_orderkey) AS rn FROM o) WHERE rn = 1""")
def best_overlap_spell(spark, d):
    spells = link.overlap_with_fixed(order_spells(spark, d), ("s", "e"), 1998, 1999)
    return HH.pick_best_overlap(spells, ["o_custkey"], "overlap", "e", "o_orderkey").select("o_custkey", "o_orderkey", "overlap")


@query(sql="""
WITH j AS (SELECT l_orderkey, l_linenumber AS slot, CASE WHEN max(l_tax) < 0.07 THEN CAST(sum(l_quantity) AS INTEGER) + 1950 END AS e, CAST(min(l_quantity) AS INTEGER) + 1940 AS s
           FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, slot, duration FROM (SELECT l_orderkey, slot, coalesce(e, 0) - coalesce(s, 0) AS duration,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(e, 0) - coalesce(s, 0) DESC, slot) AS rn
       FROM j WHERE coalesce(e, 0) <> 0 OR slot = 1) WHERE rn = 1""")
def longest_spell(spark, d):
    jobs = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("slot")).agg(
        F.when(F.max("l_tax") < 0.07, F.sum("l_quantity").cast("int") + 1950).alias("e"),
        (F.min("l_quantity").cast("int") + 1940).alias("s"))
    return HH.pick_longest_spell(jobs, ["l_orderkey"], "s", "e", "slot").select("l_orderkey", "slot", "duration")


@query(sql=SPELLS + "SELECT o_orderkey, max(e) OVER (PARTITION BY o_custkey) AS last_year FROM spells")
def last_activity(spark, d):
    return HH.last_activity_year(order_spells(spark, d), ["o_custkey"], "e").select("o_orderkey", "last_year")
