import math

import pytest
from pyspark.sql import functions as F

from hearthline.functions import codebook
from hearthline.plans import education, joint, panel_a, panel_b


def test_job_at_forty(spark):
    rows = [
        ("a", 1940, 1960, "6 Farmer", None, None, 1979, "3 Non-agricultural Employment", "4 Firm", "1 State Controlled Firm", "boss", None),
        ("b", 1940, 1985, "x", None, None, 1990, "6 Army", None, None, "r", None),
    ]
    df = spark.createDataFrame(rows, "id string, by int, s0 int, st0 string, se0 string, f0 string, s1 int, st1 string, se1 string, f1 string, ra1 string, rb1 string")
    got = panel_a.job_at_age(df, "id", "by", "s{}", "st{}", "se{}", "f{}", ["rb{}", "ra{}"], range(19))
    # the second began no job before forty: slot 1 is taken
    assert {r.id: (r.job, r.manager) for r in got.collect()} == {"a": ("3 State Controlled Firm", "boss"), "b": ("4 Public institution", "r")}
    assert len(codebook.JOB_SECTOR) == 20


def test_home_wealth_of_both_blocks(spark):
    rows = [("h", "y", 2000000.0, None, None, None, "y", None, None, 3.0, 100.0), ("k", None, None, 12.0, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "hhid string, g1 string, t1 double, p1 double, lo1 double, hi1 double, n1 string, nt1 double, x double, nu1 double, na1 double")
    old = panel_a.HomeBlock(range(1, 8), "g{}", "t{}", "u{}", "a{}", "lo{}", "hi{}", "p{}")
    new = panel_a.HomeBlock(range(1, 12), "n{}", "nt{}", "nu{}", "na{}", "nlo{}", "nhi{}")
    got = {r.hhid: (round(r.asset_home), r.num_home) for r in panel_a.home_wealth(df, "hhid", [old, new]).collect()}
    assert got == {"h": (2_300_000, 2), "k": (120_000, 1)}


def test_children_with_transfers(spark):
    family = spark.createDataFrame([("h", "m", 1990, "f", None, None, 2000)], "hhid string, sex1 string, by1 int, sex2 string, by2 int, sex10 string, by10 int")
    gifts = spark.createDataFrame([("h", True, None, False)], "hhid string, flag1 boolean, flag2 boolean, flag10 boolean")
    kids = panel_a.children(family, "hhid", {"sex": "sex{}", "birth": "by{}"}, range(1, 17), [(gifts, {"home": "flag{}"})])
    assert {(r.childid, r.sex, r.birth, r.home) for r in kids.collect()} == {(1, "m", 1990, True), (2, "f", None, None), (10, None, 2000, False)}
    heads = spark.createDataFrame([("h", "1 Central")], "hhid string, urban_parent string")
    same = kids.withColumn("urban", F.when(F.col("childid") == 1, "same as R").otherwise("2 Rural"))
    both = panel_a.merged(same, heads, "hhid", {"urban": (F.col("urban") == "same as R", "urban_parent")})
    assert {r.childid: r.urban for r in both.collect()} == {1: "1 Central", 2: "2 Rural", 10: "2 Rural"}


def test_couples(spark):
    raw = spark.createDataFrame([(1, "Key-School", " High ", True, 12, "a", "b", "fa", "fb"), (2, None, "High", False, 9, "a", "b", "fa", "fb"),
                                 (3, "Key-School", None, None, 9, "a", "b", "fa", "fb")],
                                "pid int, g1 string, a1 string, male boolean, years int, job_res string, job_sps string, job_res_father string, job_sps_father string")
    text = panel_b.cleaned(raw, ["pid", "male", "years"])
    flagged = panel_b.key_school_flags(text, ["a1"], ["g1"], {"high": ["High"]}, {"high": ["KeySchool"]}, "years")
    both = panel_b.ordered(panel_b.husband_wife(flagged, F.col("male"), ["job"], ["job"]), "pid")
    assert both.columns[:5] == ["pid", "job_husb", "job_wife", "job_husb_father", "job_wife_father"]
    got = {r.pid: (r.key_high, r.job_husb, r.job_wife, r.job_husb_father, r.job_wife_father) for r in both.collect()}
    assert got == {1: ("TRUE", "a", "b", "fa", "fb"), 2: ("FALSE", "b", "a", "fb", "fa"), 3: ("dropout", None, None, None, None)}


def test_completed_samples(spark):
    rows = [(i, i % 3 > 0, None if i % 7 == 0 else float(i % 5), None if i % 11 == 0 else float(i % 4)) for i in range(1, 90)]
    df = spark.createDataFrame(rows, "id long, owns boolean, home double, land double")
    out = panel_a.completed(df, "id", ["home", "land"], {"home": F.col("owns")}, {"total": ["home", "land"]}, maxit=1).collect()
    assert len(out) == 89 and all(r.total == r.home + r.land for r in out)
    for i, owns, home, land in rows:
        r = next(r for r in out if r.id == i)
        assert r.home == (0 if not owns else r.home if home is None else home) and (land is None or r.land == land)
    kinds = [(i, None if i % 9 == 0 else ("TRUE", "FALSE", "dropout")[i % 3], float(i % 3)) for i in range(1, 80)]
    couples = spark.createDataFrame(kinds, "pid long, key_high string, years double")
    got = {r.pid: r.key_high for r in panel_b.completed(couples, "pid", ["key_high", "years"], ["key_high"], maxit=1).collect()}
    assert all(got[i] == {"TRUE": True, "FALSE": False, "dropout": None}[k] for i, k, _ in kinds if k)


def test_education_report(spark):
    rows = [(y, f, g) for y in (0, 6, 9, 12, 15, 16, None) for f in (3, 6, 9, 10, 14) for g in ("r", "u")]
    people = spark.createDataFrame(rows, "years int, father int, place string")
    curve = {(r["diploma_parent"], r["place"]): r for r in education.schooling_curve(people, "father", "place", "years").collect()}
    assert len(curve) == 8 and curve["4 Senior High >", "u"]["n"] == 7  # ten years stand for no diploma; unknown years count among n alone
    assert curve["2 Primary", "r"]["mean"] == pytest.approx(58 / 6)
    fits = education.schooling_models(people, "years", ["place"])
    assert [f.name for f in fits] == ["years", "15+", "12+", "9+"] and [f.stats["n"] for f in fits] == [60, 30, 40, 50]
    assert fits[1].estimate == pytest.approx([math.log(2), 0], abs=1e-6)  # of three that reach 12 years two go on
    table = {r["term"]: r for r in education.education_report(people, "years", ["place"]).collect()}
    assert table["n"]["12+"] == "40.000" and table["(Intercept)"]["15+"].startswith("0.693")


def test_joint_report(spark):
    families = spark.createDataFrame([("a", 10.0, "0", 5.0), ("b", 20.0, "1", 7.0), ("c", 0.0, "1", None), (None, 500.0, "1", 1.0)],
                                     "tier string, value double, homes string, net double")
    couples = spark.createDataFrame([(30.0, "0"), (50.0, None)], "value double, homes string")
    both = joint.joint_homes(families, couples, "city", "tier", "value", "homes")
    table = {r["tier"]: r for r in joint.home_value_table(both, "tier", "value").collect()}
    assert both.count() == 6 and set(table) == {"a", "b", "city", None} and table["city"]["mean"] == 40
    boxes = {(r["tier"], r["homes"]): r for r in joint.home_value_boxes(both, "tier", "value", "homes").collect()}
    assert set(boxes) == {("a", "0"), ("b", "1"), ("city", "0"), ("city", None)}  # beyond the axis: dropped first
    out = {(r["tier"], r["type"]): r for r in joint.wealth_by_tier(
        families, couples, "tier", {"b": "bc", "c": "bc"}, "city", {"home": ("value", 2.0), "net": ("net", 1.0)}, {"home": ("value", 3.0)}).collect()}
    assert out["bc", "home"]["metric"] == 20 and out["bc", "net"]["metric"] == 7 and out["bc", "net"]["num"] == 2
    assert out["city", "home"]["metric"] == 120 and out["city", "net"]["metric"] is None and out[None, "home"]["metric"] == 1000
    empty = joint.wealth_by_tier(families.filter("false"), couples.filter("false"), "tier", {"b": "bc"}, "city", {"home": ("value", 2.0)}, {"home": ("value", 3.0)}).collect()
    assert [(r["tier"], r["num"], r["metric"]) for r in empty] == [("city", 0, None)]


def test_profile_of_clusters_that_hold_their_sequences(spark):
    """The same counts with and without a join by id; with the sequences there is no join of people in the plan."""
    from hearthline.plans import life_course

    people = spark.createDataFrame([(1, ["a", None]), (2, ["a", "b"]), (3, ["a", "b"]), (4, ["b", "b"]), (None, ["a", "a"])], "id int, seq array<string>")
    clusters = people.withColumn("cluster", (F.col("seq")[0] == "b").cast("int"))
    held, joined = life_course.cluster_profile(people, clusters, "id"), life_course.cluster_profile(people, clusters.drop("seq"), "id")
    want = {(0, 0, "a", 3, 1.0), (0, 1, "*", 1, 1 / 3), (0, 1, "b", 2, 2 / 3), (1, 0, "b", 1, 1.0), (1, 1, "b", 1, 1.0)}
    assert {(r.cluster, r.pos, r.state, r.n, r.share) for r in held.collect()} == want == {(r.cluster, r.pos, r.state, r.n, r.share) for r in joined.collect()}
    assert held.columns == joined.columns


def test_life_courses_are_compared_over_forty_years(spark, tmp_path):
    """Of yearly states to year 60 the last forty count, with the start and all six changes."""
    from hearthline.catalog import flows

    early = [(i, k, q, 0.0, d) for i in (1, 2, 3) for k, q, d in ((1, 10.0, 0.0), (2, 40.0, 0.06))]  # thirty years in agriculture, the last twenty out of it
    late = [(4, k, 5.0 * k, 0.0, 0.06 if k == 7 else 0.0) for k in range(1, 8)]  # out by the seventh line alone, for the last 25 years
    steady = [(i, 1, 10.0, 0.0, 0.03) for i in (5, 6)]
    rows = spark.createDataFrame(early + late + steady, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = flows.study_life_course(spark, str(tmp_path)).groupBy("pos", "state").agg(F.sum("n").alias("n")).collect()
    want = {(p, "in"): 2 for p in range(40)} | {(p, "AG"): 4 if p < 15 else 3 for p in range(20)}
    want |= {(p, "out"): 1 if p < 20 else 4 for p in range(15, 40)}
    assert {(r.pos, r.state): r.n for r in got} == want
