"""The way for hot groups gives what the plain way gives."""

import random

import pytest
from pyspark.sql import functions as F

from hearthline.operators import skew


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randint(0, 20), i, rng.random()) for i in range(600)]
    return spark.createDataFrame(data, "k string, x int, id int, w double").repartition(5)


def brute(rows, f):
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.k, []).append(r)
    return f(groups)


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_total(rows, hot, keys):
    assert skew.hot_groups(rows, keys)
    got = {r.id: r.n for r in skew.running_total(rows, keys, [F.col("x").desc(), F.col("id")], "n").collect()}
    data = rows.collect()
    want = {}
    for r in data:
        same = [s for s in data if not keys or s.k == r.k]
        want[r.id] = sum((-s.x, s.id) <= (-r.x, r.id) for s in same)
    assert got == want


def test_weighted_total(rows, hot):
    got = {r.id: r.s for r in skew.running_total(rows, ["k"], [F.col("id").asc()], "s", F.col("w")).collect()}
    data = rows.collect()
    for r in data:
        assert got[r.id] == pytest.approx(sum(s.w for s in data if s.k == r.k and s.id <= r.id))


@pytest.mark.parametrize("limit", ["3", "1000000"])
def test_next_in_group(spark, rows, limit):
    spark.conf.set("spark.hearthline.hotRows", limit)
    got = {r.id: r.nxt for r in skew.next_in_group(rows, ["k"], [F.col("x").asc(), F.col("id").asc()], {"nxt": "id"}).collect()}
    spark.conf.unset("spark.hearthline.hotRows")
    want = {}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.k, []).append((r.x, r.id))
    for g in groups.values():
        g.sort()
        want |= {a[1]: b[1] for a, b in zip(g, g[1:])} | {g[-1][1]: None}
    assert got == want


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
@pytest.mark.parametrize("match", [True, False])
def test_lookup_join(spark, rows, hot, how, match):
    table = spark.createDataFrame([("hot", 1), ("a", 2), (None, 3), ("zz", 4)], "k string, v int")
    got = sorted(map(repr, map(tuple, skew.lookup_join(rows, table, ["k"], how, match).collect())))
    spark.conf.set("spark.hearthline.hotRows", "1000000")
    want = sorted(map(repr, map(tuple, skew.lookup_join(rows, table, ["k"], how, match).collect())))
    assert got == want and len(got) > 100


def test_quantiles(rows, hot):
    got = {r.k: (r.q1, r.q2, r.hi) for r in skew.group_quantiles(rows, ["k"], "w", {"q1": 0.25, "q2": 0.5, "hi": 1.0}).collect()}
    import numpy as np

    groups = {}
    for r in rows.collect():
        groups.setdefault(r.k, []).append(r.w)
    for k, v in groups.items():
        assert got[k] == pytest.approx(tuple(np.quantile(v, [0.25, 0.5, 1.0])))


def test_hot_list_is_bounded(spark, rows, hot):
    many = spark.range(5000).select((F.col("id") % 500).alias("k"))
    assert len(skew.hot_groups(many, ["k"])) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sampled_detection_and_result(spark):
    """A third of all rows in one group: found on the sample, ranked and joined whole."""
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 7000).alias("k"), "id", F.xxhash64("id").alias("x"))
    found = skew.hot_groups(df, ["k"], 4000)
    assert [r.k for r in found] == [-1]
    plain = skew.running_total(df, ["k"], [F.col("x").asc(), F.col("id").asc()], "n", hot=[])
    split = skew.running_total(df, ["k"], [F.col("x").asc(), F.col("id").asc()], "n", hot=found)
    assert split.count() == 30000 and plain.exceptAll(split).count() == 0
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    a = skew.lookup_join(df, sizes, ["k"], hot=[])
    b = skew.lookup_join(df, sizes, ["k"], hot=found)
    assert a.exceptAll(b).count() == 0 and b.count() == 30000


def test_hot_rows_spread_over_partitions(spark):
    df = spark.range(20000).select(F.lit(1).alias("k"), "id")
    split = skew.running_total(df, ["k"], [F.col("id").asc()], "n", hot=skew.hot_groups(df, ["k"], 100))
    sizes = [r["count"] for r in split.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 12000


def test_copies_of_one_row_are_spread(spark):
    """Rows that are nothing but the hot key still go to several partitions."""
    df = spark.range(0, 8000, 1, 16).select(F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("1", 2)], "k string, v int").hint("shuffle_hash")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.lookup_join(df, table, ["k"], hot=skew.hot_groups(df, ["k"], 500))
        parts = joined.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    hot_total = df.filter("k = 'hot'").count()
    assert sum(r["count"] for r in parts) == hot_total
    assert len(parts) > 1 and max(r["count"] for r in parts) < 0.8 * hot_total
    assert joined.count() == 8000 and joined.filter("v = 1").count() == hot_total
