from pyspark.sql import functions as F

from hearthline.functions import household as H
from hearthline.operators import household as HH, link, shape


def test_property_value_cascade(spark):
    rows = [
        ("y", 80.0, 2.0, 100.0, None, None, 7.0),   # total wins
        ("y", None, 2.0, 100.0, None, None, 7.0),   # unit price times area
        ("y", None, None, 100.0, 1000.0, 3000.0, 7.0),  # middle of the bracket times area
        ("y", None, None, None, None, None, 7.0),   # a new value was given but is unknown
        (None, 80.0, 2.0, 100.0, None, None, 7.0),  # nothing new: earlier wave
        (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "g string, t double, u double, a double, lo double, hi double, p double")
    got = [r[0] for r in df.select(H.property_value("g", "t", "u", "a", "lo", "hi", "p")).collect()]
    assert got == [80.0, 20.0, 20.0, 0.0, 7.0, 0.0]


def test_brackets(spark):
    df = spark.createDataFrame([(None, 10.0, None), (5.0, 4.0, 2.0), (None, None, 6.0), (None, None, None)], "e double, hi double, lo double")
    got = df.select(H.bracket_midpoint("e", "hi", "lo"), H.bracket_fallback("lo", "hi")).collect()
    assert [tuple(r) for r in got] == [(5.0, 10.0), (8.0, 3.0), (3.0, 6.0), (0.0, None)]


def test_nearest_job(spark):
    rows = [(1, 1970, 1985, 1960), (2, 1985, 1985, 1960), (3, 2001, 2002, 2003), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id int, s1 int, s2 int, s12 int")
    wide = df.select("id", H.nearest_before_slot([("1", "s1"), ("2", "s2"), ("12", "s12")], F.lit(1990)).alias("slot"))
    assert [r.slot for r in wide.orderBy("id").collect()] == ["2", "1", "1", "1"]
    long = df.unpivot("id", ["s1", "s2", "s12"], "name", "start").withColumn("slot", shape.slot_from_name("name"))
    picked = HH.nearest_before(long, ["id"], F.lit(1990) - F.col("start"), "slot")
    assert [r.slot for r in picked.orderBy("id").collect()] == ["2", "1", "1", "1"]


def test_blocks_with_two_digit_slots(spark):
    df = spark.createDataFrame([(1, "m", None, "f", 30)], "hhid int, sex1 string, sex9 string, sex11 string, age16 int")
    got = shape.unpivot_blocks(df, ["hhid"], {"sex": "sex{}", "age": "age{}"}, range(1, 17), "childid").orderBy("childid").collect()
    assert [tuple(r) for r in got] == [(1, 1, "m", None), (1, 11, "f", None), (1, 16, None, 30)]
    slots = spark.createDataFrame([("x_9_",), ("x_16_",), ("x",)], "n string").select(shape.slot_from_name("n")).collect()
    assert [r[0] for r in slots] == [9, 16, None]


def test_unpivot_then_pivot_is_identity(spark):
    df = spark.createDataFrame([(1, 10, 20), (2, 30, 40)], "id int, v1 int, v2 int")
    long = shape.unpivot(df, ["id"], ["v1", "v2"])
    back = long.groupBy("id").pivot("key", ["v1", "v2"]).agg(F.first("value"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_householder(spark):
    rows = [("a", 1, "mother"), ("b", 2, "father"), ("b", 3, "mother"), ("b", 4, "father"), ("c", 5, "other")]
    df = spark.createDataFrame(rows, "hhid string, id int, role string")
    assert sorted(map(tuple, HH.householder(df, ["hhid"], "role", ["father", "mother"], "id").select("hhid", "id").collect())) == [("a", 1), ("b", 2), ("c", 5)]


def test_twins_get_different_ranks(spark):
    df = spark.createDataFrame([("a", 1, 30), ("a", 2, 30), ("a", 3, None), ("b", 1, 5)], "hhid string, childid int, age int")
    got = HH.sibling_rank(df, ["hhid"], [F.col("age").desc_nulls_last(), F.col("childid")])
    assert sorted((r.hhid, r.childid, r.sibling_rank) for r in got.collect()) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1)]


def test_sample_one_is_repeatable(spark):
    df = spark.range(300).select((F.col("id") % 40).alias("hhid"), "id")
    a = {r.hhid: r.id for r in HH.sample_one(df, ["hhid"], ["id"], 3).collect()}
    b = {r.hhid: r.id for r in HH.sample_one(df.repartition(7), ["hhid"], ["id"], 3).collect()}
    other = {r.hhid: r.id for r in HH.sample_one(df, ["hhid"], ["id"], 4).collect()}
    assert a == b and len(a) == 40 and a != other


def test_sum_of_missing_is_zero_and_mean_missing(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0), ("b", None), ("c", 4.0)], "k string, x double")
    assert {r.k: r.x for r in HH.group_sum(df, ["k"], ["x"]).collect()} == {"a": 0.0, "b": 2.0, "c": 4.0}
    assert {r.k: r.x for r in HH.group_mean_strict(df, ["k"], ["x"]).collect()} == {"a": None, "b": None, "c": 4.0}


def test_longest_spell_rules(spark):
    rows = [("a", 1, 1960, 1970), ("a", 2, 1970, None), ("a", 3, 1975, 1985), ("a", 0, 1900, 1999), ("b", 1, None, None), ("b", 2, 1980, 1981)]
    df = spark.createDataFrame(rows, "id string, slot int, s int, e int")
    assert {r.id: r.slot for r in HH.pick_longest_spell(df, ["id"], "s", "e", "slot").collect()} == {"a": 1, "b": 2}


def test_best_overlap_falls_back_to_earliest_end(spark):
    df = spark.createDataFrame([("a", 1, 1950, 1960), ("a", 2, 1940, 1955), ("b", 1, 1950, 1991), ("b", 2, 1990, 2000)], "id string, n int, s int, e int")
    spells = link.overlap_with_fixed(df, ("s", "e"), 1988, 1998)
    assert {r.id: (r.n, r.overlap) for r in HH.pick_best_overlap(spells, ["id"], "overlap", "e", "n").collect()} == {"a": (2, 0), "b": (2, 9)}


def test_touching_spells_share_a_year(spark):
    df = spark.createDataFrame([(1990, 1995, 1995, 1999), (1990, 1994, 1995, 1999), (None, 1994, 1995, 1999)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(H.overlap_years("a", "b", "c", "d")).collect()] == [1, 0, None]


def test_job_cascade_and_roles(spark):
    df = spark.createDataFrame([("2 Agricultural Employment", "4 Firm", "f"), ("2 Agricultural Employment", "s", "f"), ("6 Farmer", "4 Firm", "f"), (None, "4 Firm", "f")],
                               "a string, b string, c string")
    assert [r[0] for r in df.select(H.job_detail_cascade("a", "b", "c")).collect()] == ["f", "s", "6 Farmer", None]
    pair = spark.createDataFrame([(True, 1, 2), (False, 1, 2), (None, 1, 2)], "male boolean, x_res int, x_sps int")
    swapped = H.swap_roles(F.col("male"), ["x"])
    assert [tuple(r) for r in pair.select(swapped["x_husb"], swapped["x_wife"]).collect()] == [(1, 2), (2, 1), (None, None)]


def test_episode_flags(spark):
    rows = [([("high", "key"), ("high", "plain")],), ([("high", "plain")],), ([("middle", "key")],), ([("high", None)],)]
    df = spark.createDataFrame(rows, "e array<struct<kind:string,school:string>>")
    assert [r[0] for r in df.select(H.episode_flags(F.col("e"), ["high"], ["key"])).collect()] == [True, False, None, False]


def test_missing_keys_join_only_on_request(spark):
    left = spark.createDataFrame([("a",), (None,)], "k string")
    right = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    assert {r.k: r.v for r in link.left_join(left, right, ["k"]).collect()} == {"a": 1, None: None}
    assert {r.k: r.v for r in link.left_join(left, right, ["k"], missing_keys_match=True).collect()} == {"a": 1, None: 2}


def test_householder_of_other_roles(spark):
    """A household without a listed role still has its first person."""
    rows = [("a", 2, "mother"), ("a", 1, None), ("b", 5, None), ("c", 7, "aunt"), ("c", 6, "cousin")]
    df = spark.createDataFrame(rows, "hhid string, id int, role string")
    assert sorted(map(tuple, HH.householder(df, ["hhid"], "role", ["father", "mother"], "id").select("hhid", "id").collect())) == [("a", 2), ("b", 5), ("c", 6)]


def test_city_listed_twice(spark):
    people = spark.createDataFrame([(1, "x"), (2, "y")], "id int, city string")
    codes = spark.createDataFrame([("x", "1"), ("x", "2")], "city string, tier string")
    assert sorted(map(tuple, link.tier_of(people, "city", codes, "4").select("id", "tier").collect())) == [(1, "2"), (2, "4")]
