from pyspark.sql import functions as F

from hearthline.sources import labelled, tables


def test_labels_and_unlabelled_codes(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, sex int").write.parquet(path)
    labels = spark.createDataFrame([("sex", 1, "1 Male"), ("other", 9, "no")], "col string, code int, label string")
    got = labelled.read_labelled(spark, path, labels, ["sex"]).orderBy("id").collect()
    assert [r.sex for r in got] == ["1 Male", "9", None]


def test_legacy_encoding(spark, tmp_path):
    path = tmp_path / "city.csv"
    path.write_bytes("cid,city\n1,上海\n2,北京\n".encode("gb2312"))
    got = labelled.read_raw_codes(spark, str(path), "cid int, city string").orderBy("cid").collect()
    assert [r.city for r in got] == ["上海", "北京"]


def test_code_list_and_levels(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text("list,value\ntier1,上海\ntier1,北京\ntier2,杭州\n", encoding="utf-8")
    codes = labelled.read_code_list(spark, str(path))
    assert {r.value for r in labelled.code_list_values(codes, "tier1").collect()} == {"上海", "北京"}
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "x string")
    assert [(r.ordinal, r.label) for r in labelled.levels_of(df, "x").orderBy("ordinal").collect()] == [(1, "a"), (2, "b")]


def test_tables_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    back = tables.checkpoint_table(df, str(tmp_path / "t"), ["x"])
    assert back.filter(F.col("x") == "b").first().id == 2
    tables.write_report_csv(df, str(tmp_path / "r"))
    tables.write_model_table(df, str(tmp_path / "m"), "parquet")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == tables.load_table(spark, str(tmp_path / "m")).count() == 2


def test_spss_extract_keeps_numbers(spark, tmp_path):
    from hearthline.sources import labelled

    spark.createDataFrame([(-12.5, " a,b ", 3), (None, "", -4)], "x double, t string, n int").write.parquet(str(tmp_path / "e"))
    rows = labelled.read_spss_extract(spark, str(tmp_path / "e")).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted([repr(("-12.5", "ab", "3")), repr((None, None, "-4"))])
    labels = spark.createDataFrame([("n", 3, "three"), ("n", 3, "drei")], "col string, code int, label string")
    assert labelled.decode_labels(spark.createDataFrame([(3,)], "n int"), labels, ["n"]).count() == 1
