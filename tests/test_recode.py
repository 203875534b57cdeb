from pyspark.sql import functions as F

from hearthline.functions import codebook, recode as R, text as X


def values(spark, data, schema, *cols):
    df = spark.createDataFrame([(*r,) if isinstance(r, tuple) else (r,) for r in data], schema)
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*cols).collect()]


def test_missing_condition_stays_missing(spark):
    assert values(spark, [True, False, None], "a boolean", R.r_ifelse(F.col("a"), "y", "n")) == ["y", "n", None]


def test_membership_is_never_missing(spark):
    got = values(spark, ["x", "y", None], "a string", R.in_set("a", ["x"]), R.not_in_set("a", ["x"]))
    assert got == [(True, False), (False, True), (False, True)]


def test_horizontal_extremes_keep_missing(spark):
    assert values(spark, [-1.0, 2.0, None], "a double", R.clip_low("a", 0.0), R.clip_high("a", 1.0)) == [(0.0, -1.0), (2.0, 1.0), (None, None)]


def test_extract_and_cast_never_raise(spark):
    got = values(spark, ["997 Don't Know", "none", None, "12"], "a string", X.extract_number("a"), F.col("a").try_cast("double"))
    assert got == [(997.0, None), (None, None), (None, None), (12.0, 12.0)]


def test_recode_keeps_or_drops_unknown(spark):
    data = ["12 No Change", "1 Yes", None]
    assert values(spark, data, "a string", R.recode_labels("a", {"1 Yes": "Y"})) == ["12 No Change", "Y", None]
    assert values(spark, data, "a string", R.recode_labels("a", {"1 Yes": "Y"}, keep=False)) == [None, "Y", None]


def test_positional_then_sentinel(spark):
    data = [1, 11, 997, 999, 0, None]
    years = R.na_if(R.recode_positional("a", codebook.SCHOOLING_YEARS), *codebook.MISSING_CODES)
    assert values(spark, data, "a int", years) == [0, 22, None, None, 0, None]


def test_unit_borders(spark):
    data = [50.0, 51.0, 300.0, 301.0, 499.0, 500.0, 501.0, 999.0, 1000.0, 1001.0, None]
    assert values(spark, data, "a double", R.fix_units("a", codebook.TOTAL_VALUE_RULES)) == [
        50, 51, 300, 301, 499, 500, 500, 500, 0.1, 0.1001, None]
    assert values(spark, data[:2], "a double", R.fix_units("a", codebook.UNIT_PRICE_RULES)) == [50, 0.051]


def test_cut_edges(spark):
    data = [0.0, 1.0, 2.0, 3.0, None]
    assert values(spark, data, "a double", R.cut("a", [0, 1, 2], ["p", "q"])) == [None, "p", "q", None, None]
    assert values(spark, data, "a double", R.cut("a", [0, 1, 2], ["p", "q"], include_lowest=True)) == ["p", "p", "q", None, None]


def test_later_mask_wins(spark):
    got = values(spark, [1, 5, 9, None], "a int", R.mask_ladder(F.lit("s"), (F.col("a") > 2, "b"), (F.col("a") > 6, "c")))
    assert got == ["s", "b", "c", "s"]


def test_collapse_level_to_missing(spark):
    assert values(spark, ["a", "b", "c", None], "a string", R.collapse_levels("a", {"a": "b", "c": None})) == ["b", "b", None, None]


def test_row_sums(spark):
    data = [(1.0, 2.0), (1.0, None), (None, None)]
    assert values(spark, data, "a double, b double", R.row_sum("a", "b"), R.row_sum("a", "b", na_zero=True), R.row_count_positive("a", "b")) == [
        (3.0, 3.0, 2), (None, 1.0, 1), (None, 0.0, 0)]


def test_net_worth_can_be_negative(spark):
    assert values(spark, [(1.0, 5.0), (None, None)], "a double, b double", R.net_worth(["a"], ["b"])) == [-4.0, 0.0]


def test_log_of_non_positive_is_missing(spark):
    got = values(spark, [-60.0, -50.0, 0.0], "a double", R.log_shift("a", 50), R.log_shift("a", 1, floor=0.0))
    assert [g[0] is None for g in got] == [True, True, False] and all(g[1] == 0.0 for g in got)


def test_text(spark):
    got = values(spark, [" a-b. c", "..", None], "a string", X.strip_text("a"), X.paste("a", F.lit("z")), X.str_c("a", F.lit("z")))
    assert got == [("abc", " a-b. c z", " a-b. cz"), (None, ".. z", "..z"), (None, "NA z", None)]
