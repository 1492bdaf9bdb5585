from pyspark.sql import functions as F

from creel.functions import columns as C, nulls as N, scalars as S


def one(spark, ddl, values, expr):
    df = spark.createDataFrame([(v,) for v in values], f"x {ddl}")
    return [r[0] for r in df.select(expr).collect()]


def test_lenient_and_strict_sums(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), ("b", None), ("c", 1.0), ("c", 2.0)], "k string, x double")
    got = df.groupBy("k").agg(N.sum_or_zero("x"), N.sum_strict("x"), N.mean_strict("x")).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [(0.0, None, None), (1.0, None, None), (3.0, 3.0, 1.5)]


def test_distinct_counts_missing_as_a_value(spark):
    df = spark.createDataFrame([(1, True), (1, True), (None, True), (2, False), (3, None)], "x int, f boolean")
    got = df.agg(N.n_distinct("x"), N.n_distinct_if("f", "x"), N.n_distinct_where("f", "x")).first()
    # flagged: 1 and missing; the row with a missing flag adds one missing value, already there
    assert tuple(got) == (4, 2, 2)
    only = spark.createDataFrame([(1, True), (3, None)], "x int, f boolean")
    assert tuple(only.agg(N.n_distinct_if("f", "x"), N.n_distinct_where("f", "x")).first()) == (2, 1)


def test_row_mean(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (1.0, 2.0, 3.0), (None, None, None)], "a double, b double, c double")
    got = df.select(N.row_mean("a", "b", "c"), N.row_mean("a", "b", "c", ignore_missing=True)).collect()
    assert [tuple(r) for r in got] == [(None, 2.0), (2.0, 2.0), (None, None)]


def test_title_case_and_toponyms(spark):
    names = ["L'ABER WRAC'H", "SAINT-MALO", "RUISSEAU DE L'EAU", "NR", "LE TRIEUX (AMONT)", None]
    assert one(spark, "string", names, S.toponym("x")) == [
        "L'Aber Wrac'h",
        "Saint-Malo",
        "Ruisseau de l'Eau",
        "Bassin non nommé",
        "Le Trieux (Amont)",
        None,
    ]


def test_pad_keeps_long_text(spark):
    assert one(spark, "string", ["12", "123456789", None], S.pad_left("x", 8)) == ["00000012", "123456789", None]


def test_number_text_and_keys(spark):
    xs = [-2.5, 3.0, 0.0000012, 1234567.1234567, -0.00000001, 100.0, None]
    assert one(spark, "double", xs, S.number_text("x")) == ["-2.5", "3", "0.000001", "1234567.123457", "0", "100", None]
    df = spark.createDataFrame([(1.25, None)], "x double, y double")
    assert df.select(S.coordinate_key("x", "y")).first()[0] == "1.25_NA"


def test_stars_bounds_are_open(spark):
    ps = [0.1, 0.07, 0.05, 0.04, 0.01, 0.005, 0.001, 0.0005, 0.0, None]
    assert one(spark, "double", ps, S.stars("x")) == ["", "(.)", "", "(*)", "", "(**)", "", "(***)", "(***)", ""]


def test_two_way_keeps_missing(spark):
    assert one(spark, "int", [1, -1, None], S.two_way(F.col("x") > 0, "y", "n")) == ["y", "n", None]
    assert one(spark, "int", [1, 0, None], S.presence_state("x")) == ["Présence", "Absence", None]


def test_rounding(spark):
    assert one(spark, "double", [0.5, 1.5, 2.5], S.round_even("x")) == [0.0, 2.0, 2.0]
    assert one(spark, "double", [0.0, 12345.0, 0.0012345, -98.7, None], S.signif("x", 2)) == [0.0, 12000.0, 0.0012, -99.0, None]
    assert one(spark, "double", [0.125, 1.0, None], S.percent_text("x", 1)) == ["12.5%", "100.0%", None]
    assert one(spark, "double", [0.12345], S.signif_percent_text("x")) == ["12%"]


def test_logs_and_missing(spark):
    assert one(spark, "double", [0.0, None], F.ln("x")) == [None, None]
    assert one(spark, "double", [0.0, 2.0], S.null_if("x", 0.0)) == [None, 2.0]
    assert one(spark, "double", [0.5, 1.0, None], S.null_below("x", 1)) == [None, 1.0, None]
    assert one(spark, "double", [None, 100.0], S.arcsine_share("x"))[0] == 0.0


def test_casts_never_raise(spark):
    assert one(spark, "string", ["1.9", "x", None], S.to_whole("x")) == [1, None, None]
    assert one(spark, "string", ["2001-02-30", "2001-02-03"], S.to_day("x").cast("string")) == [None, "2001-02-03"]


def test_repair_utf8(spark):
    assert one(spark, "string", ["SÃ©lune", "Sélune", "œuf", "abc", None], S.repair_utf8("x")) == [
        "Sélune", "Sélune", "œuf", "abc", None,
    ]


def test_levels(spark):
    levels = ["Non détecté", "Absent", "Présent"]
    got = one(spark, "string", ["Absent", "Présent", "?"], S.level_rank("x", levels))
    assert got == [2, 3, None]
    assert one(spark, "int", [1, 3, 9], S.level_label("x", levels)) == ["Non détecté", "Présent", None]


def test_column_selection_and_reshaping(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "z")], "id int, v_a double, v_b double, t string")
    assert C.cols_between(df, "v_a", "t") == ["v_a", "v_b", "t"]
    assert C.cols_starting(df, "V_") == ["v_a", "v_b"] and C.cols_ending(df, "_b") == ["v_b"]
    assert C.cols_of_type(df, "double") == ["v_a", "v_b"] and C.numeric_cols(df) == ["id", "v_a", "v_b"]
    assert C.cols_except(df, "t") == ["id", "v_a", "v_b"]
    long = C.to_long(df, ["id"], ["v_a", "v_b"])
    assert sorted(tuple(r) for r in long.collect()) == [(1, "v_a", 2.0), (1, "v_b", 3.0)]
    wide = C.to_wide(long, ["id"], "name", "value", ["v_a", "v_b", "v_c"], 0.0)
    assert tuple(wide.first()) == (1, 2.0, 3.0, 0.0)
    assert C.to_wide(long, ["id"], "name", "value", ["v_c"]).first()[1] is None
    assert C.select_rename(df, {"texte": "t"}, everything=True, drop=["id"]).columns == ["texte", "v_a", "v_b"]


def test_row_functions_accept_a_stream(spark, tmp_path):
    spark.createDataFrame([("SAINT-MALO", 0.0)], "nom string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("nom string, v double").parquet(str(tmp_path / "in"))
    out = stream.select(S.toponym("nom").alias("nom"), S.null_if("v", 0.0).alias("v"))
    q = out.writeStream.format("memory").queryName("t_stream").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("t_stream").collect()] == [("Saint-Malo", None)]
