import pytest
from pyspark.sql import functions as F

from conftest import rows
from creel.functions import scalars as S
from creel.operators import spatial as SP
from creel.plans import atlas as A, macroecology as M, values as V

RULES = A.Rules(2014, V.ATLAS_PATTERN, V.DROPPED_SPECIES, V.TROUT_RECODE)


@pytest.fixture(scope="module")
def captures(spark):
    first = spark.createDataFrame(
        [
            ("s1", "2015-05-01", "2015", "TRF", 2.0, "Pêche complète à un passage", 1.0, 2.0),
            ("s1", "2015-05-01", "2015", "TRM", 1.0, "Pêche complète à un passage", 1.0, 2.0),
            ("s1", "2015-05-01", "2015", "PCC", 9.0, "Pêche complète à un passage", 1.0, 2.0),
            ("s2", "2014-05-01", "2014", "TRF", 5.0, "Pêche complète à un passage", 1.5, 2.0),
        ],
        "code_station string, date_peche string, annee string, code_espece string, effectif double, type_peche string, x_wgs84 double, y_wgs84 double",
    )
    second = spark.createDataFrame(
        [("s3", None, "ANG", 4.0, "Indices ponctuels", 3.0, 2.0), ("s3", None, "TRF", None, "Indices ponctuels", 3.0, 2.0)],
        "code_station string, annee string, code_espece string, effectif double, type_peche string, x_wgs84 double, y_wgs84 double",
    )
    return A.clean_captures([first, second], RULES)


def test_clean_captures(captures):
    got = rows(captures.select("ope_id", "code_espece", "effectif"), "ope_id", "code_espece")
    assert got == [
        ("1_2s12015-05-012015", "TRF", 3.0),  # trout of both forms, in one record
        ("3_2s3NANA", "ANG", 4.0),  # an unknown year stays
        ("3_2s3NANA", "TRF", 0.0),
    ]


def test_statuses_and_effort(captures):
    points = A.point_statuses(captures, RULES)
    got = rows(points.select("code_station", "code_espece", "statut"), "code_station", "code_espece")
    assert got == [("s1", "ANG", "Absent"), ("s1", "TRF", "Présent"), ("s3", "ANG", "Présent"), ("s3", "TRF", "Non détecté")]
    placed = captures.withColumn("bv", F.lit("b"))
    by_basin = A.basin_statuses(placed, "bv", RULES)
    assert rows(by_basin.select("annee", "code_espece", "statut"), "code_espece") == [(2015, "ANG", "Absent"), (2015, "TRF", "Présent")]
    assert rows(A.basin_effort(placed, "bv", RULES)) == [("b", 1, 1, 1)]  # the year of s3 is unknown


def test_values_are_consistent(spark):
    assert len(V.DROPPED_SPECIES) == 30 == len(set(V.DROPPED_SPECIES)) and len(V.ZERO_IS_MISSING) == 9
    protocols = spark.createDataFrame([(p,) for p in V.RICHNESS_PROTOCOLS], "p string")
    flags = {r[0]: r[1] for r in protocols.select("p", S.pattern_flag("p", V.ATLAS_PATTERN)).collect()}
    assert flags["Pêche complète à un ou plusieurs passages"] and not flags["partiel"]
    names = spark.createDataFrame([("GRE", "gremille"), ("ABL", "Ablette")], "c string, n string")
    fixed = names.select(S.case_label("c", V.COMMON_NAMES, default=F.col("n"))).collect()
    assert [r[0] for r in fixed] == ["Grémille", "Ablette"]


def test_macroecology_composition(spark):
    lots = spark.createDataFrame([(o, f"x{(o * s) % 5}", float(s)) for o in range(1, 41) for s in range(1, 5)], "op int, sp string, n double")
    ops = spark.createDataFrame([(o, o % 12, (o % 12) % 3, 2000 + o) for o in range(1, 41)], "op int, pt int, bv int, y int")
    env = spark.createDataFrame([(p, float(p), float(p * p % 7)) for p in range(11)], "pop int, a double, b double")
    points = M.point_diversity(lots, ops, "op", "pt", "y", "sp", "n", inventory=F.col("op") > 2, recode={"x0": "x1"})
    assert points.count() == 12 and points.agg(F.max("richesse")).first()[0] <= 4
    table = M.index_models(points, env, "pt", "pop", ["a", "b"], ["richesse", "shannon"])
    assert table.count() == 8
    both = M.local_and_basin_richness(lots, ops, "op", "pt", "bv", "y", "sp").collect()
    assert {r["bv"] for r in both} == {0, 1, 2} and all(r["rsr_abs"] >= r["rsr_obs"] for r in both)


def test_placed_statuses_read_the_captures_once(spark, captures, tmp_path):
    """The places, the species and the statuses come from one written copy of the captures."""
    captures.write.parquet(f"{tmp_path}/captures.parquet")
    source = spark.read.parquet(f"{tmp_path}/captures.parquet")
    box = SP.rectangle(F.lit(-1e9), F.lit(-1e9), F.lit(1e9), F.lit(1e9))
    basins = spark.range(1).select(F.lit("b").alias("bassin"), box.alias("rings"))
    out = A.placed_statuses(source, basins, ["bassin"], "rings", RULES)
    assert out.count() > 0 and out.select("bassin").distinct().collect() == [("b",)]
    assert out.inputFiles() and not [f for f in out.inputFiles() if "captures.parquet" in f]
