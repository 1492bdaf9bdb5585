import pytest
from pyspark.sql import functions as F

from conftest import rows
from creel.operators import presence as PR


@pytest.fixture
def small(spark):
    data = [
        (1, "Pêche complète", "A", 2.0), (1, "Pêche complète", "B", 0.0),
        (2, "Atlas inconnu", "A", 1.0), (2, "Atlas inconnu", "C", 4.0),
        (3, None, "B", 0.0), (3, None, "C", None), (4, "Pêche complète", "Z", 0.0),
    ]
    return spark.createDataFrame(data, "op int, proto string, sp string, n double")


def test_species_ever_present_is_strict(small):
    assert rows(PR.species_ever_present(small, "sp", "n")) == [("A",)]


def test_absences_brute_force(spark, small):
    vocab = spark.createDataFrame([("A",), ("B",), ("C",)], "sp string")
    want = [(1, "B"), (1, "C"), (2, "B"), (3, "A"), (3, "B")]  # the missing count of (3, C) is neither
    for width in (63, 2, 1):
        got = PR.absences(small, "op", "sp", "n", vocab, ["proto"], width=width)
        assert rows(got.select("op", "sp")) == want
        assert {r[0] for r in got.select("n").collect()} == {0.0}


@pytest.mark.parametrize("width", [63, 1])
def test_point_table_covers_operations_times_species(spark, width):
    data = [(o, ["Pêche complète", "autre", None][o % 3], f"s{s}", float((o * s) % 4)) for o in range(12) for s in range(5) if (o + s) % 2]
    data += data[:4]
    df = spark.createDataFrame(data, "op int, proto string, sp string, n double")
    out = PR.point_table(df, "op", "sp", "n", "proto", "complète", width=width).collect()
    total = {}
    proto = {}
    for o, p, s, n in data:
        total[o, s] = total.get((o, s), 0) + n
        proto[o] = p
    vocab = {s for (_, s), n in total.items() if n > 0}
    ops = {o for (o, s) in total if s in vocab}
    want = set()
    for o in ops:
        for s in vocab:
            n = total.get((o, s), 0.0)
            status = "Présent" if n > 0 else ("Absent" if proto[o] == "Pêche complète" else "Non détecté")
            want.add((o, s, n, status, PR.STATUS_LEVELS.index(status) + 1))
    assert {(r["op"], r["sp"], r["n"], r["statut"], r["rang"]) for r in out} == want
    assert len(out) == len(ops) * len(vocab)


def test_status_by_is_the_maximum_of_the_point_table(spark):
    data = [(o, o % 4, ["complète", "autre"][o % 2], f"s{s}", float((o + s) % 3)) for o in range(20) for s in range(6) if (o * s) % 5 != 1]
    df = spark.createDataFrame(data, "op int, bv int, proto string, sp string, n double")
    table = PR.point_table(df, "op", "sp", "n", "proto", "complète", ["bv"])
    want = rows(PR.highest_status(table, ["bv", "sp"]).select("bv", "sp", "rang", "statut"), "bv", "sp")
    vocab = PR.species_ever_present(df, "sp", "n")
    got = PR.status_by(df, ["bv"], "sp", "n", F.col("proto").rlike("complète"), vocab)
    assert rows(got.select("bv", "sp", "rang", "statut"), "bv", "sp") == want


def test_blocks_of_any_width_give_the_same_rows(spark):
    """Ten species in one, two, five and ten blocks, and a vocabulary of more than one word."""
    data = [(o, o % 3, "complète" if o % 4 else "autre", f"s{(o * k) % 10:02}", float((o + k) % 3)) for o in range(30) for k in range(1, 5)]
    df = spark.createDataFrame(data, "op int, bv int, proto string, sp string, n double")
    vocab = spark.createDataFrame([(f"s{i:02}",) for i in range(10)] + [("s03",), (None,)], "sp string")
    many = spark.createDataFrame([(f"s{i:02}",) for i in range(200)], "sp string")
    full = F.col("proto").rlike("complète")
    found = []
    for width in (10, 5, 2, 1):
        one = rows(PR.absences(df, "op", "sp", "n", vocab, ["proto"], width=width))
        two = rows(PR.point_table(df, "op", "sp", "n", "proto", "complète", ["bv"], vocab, width=width), "op", "sp")
        three = rows(PR.status_by(df, ["bv"], "sp", "n", full, vocab, width=width), "bv", "sp")
        found.append((one, two, three))
    assert all(x == found[0] for x in found) and len(found[0][1]) == 300 and len(found[0][2]) == 30
    assert PR.point_table(df, "op", "sp", "n", "proto", "complète", vocabulary=many).count() == 30 * 200
    assert PR.point_table(df, "op", "sp", "n", "proto", "complète", vocabulary=vocab.limit(0)).count() == 0


def test_names_travel_with_the_dictionary(spark):
    df = spark.createDataFrame([(1, "p", "A", 1.0), (1, "p", "B", 0.0)], "op int, proto string, sp string, n double")
    vocab = spark.createDataFrame([("A",), ("B",), ("C",)], "sp string")
    names = spark.createDataFrame([("A", "Anguille"), ("C", "Carpe"), ("Z", "Zope")], "sp string, nom string")
    got = PR.point_table(df, "op", "sp", "n", "proto", "complète", vocabulary=vocab, names=names, name_col="nom")
    assert rows(got.select("sp", "nom", "rang")) == [("A", "Anguille", 3), ("B", None, 1), ("C", "Carpe", 1)]


@pytest.mark.parametrize("first, second", [("partielle", "complète"), ("complète", "partielle")])
def test_an_operation_counts_by_its_highest_protocol(spark, first, second):
    data = [(1, "b", first, "A", 1.0), (1, "b", second, "B", 2.0), (2, "b", "partielle", "C", 1.0)]
    df = spark.createDataFrame(data, "op int, bv string, proto string, sp string, n double").repartition(2)
    table = PR.point_table(df, "op", "sp", "n", "proto", "complète", ["bv"])
    assert rows(table.where("op = 1").select("sp", "statut", "proto")) == [("A", "Présent", "complète"), ("B", "Présent", "complète"), ("C", "Absent", "complète")]
    vocab = PR.species_ever_present(df, "sp", "n")
    want = rows(PR.highest_status(table, ["op", "bv", "sp"]).select("op", "sp", "statut"))
    got = PR.status_by(df, ["op"], "sp", "n", F.col("proto").rlike("complète"), vocab)
    assert rows(got.select("op", "sp", "statut")) == want
    for code in "ABCZ":
        one = PR.status_of(df, ["op"], "sp", "n", F.col("proto").rlike("complète"), vocab, code)
        assert rows(one.select("op", "sp", "statut")) == [x for x in want if x[1] == code]


def test_status_order_and_map(spark):
    df = spark.createDataFrame([(1, "x", s) for s in ("Absent", "Non détecté", "Présent")] + [(2, "x", "Absent"), (2, "x", None)], "p int, sp string, statut string")
    top = PR.highest_status(df, ["p"])
    assert rows(top.select("p", "statut"), "p") == [(1, "Présent"), (2, None)]
    places = spark.createDataFrame([(1,), (9,)], "p int")
    assert rows(PR.status_map(places, df, "p", "sp", "x"), "p") == [(1, "Présent"), (9, "Non prospecté")]


def test_basin_card(spark):
    data = [("b1", "s1", "A", 3.0), ("b1", "s2", "A", 0.0), ("b1", "s2", "B", 1.0), ("b2", "s3", "B", 2.0), ("b3", "s4", "B", 0.0)]
    df = spark.createDataFrame(data, "bv string, st string, sp string, n double")
    basins = spark.createDataFrame([("b1",), ("b2",), ("b3",), ("b4",)], "bv string")
    got = {r["bv"]: r.asDict() for r in PR.basin_card(df, basins, "bv", "st", "sp", "n", "A").collect()}
    assert (got["b1"]["n_indiv"], got["b1"]["n_indiv_sp"], got["b1"]["n_stations_presence"], got["b1"]["presence"]) == (4, 3, 1, "Présence")
    assert (got["b1"]["pourcent_stations_presence_mini_une_fois"], got["b1"]["pourcent_indiv_captures"]) == ("50%", "75%")
    assert (got["b2"]["n_indiv_sp"], got["b2"]["n_stations_presence"], got["b2"]["presence"]) == (0, 0, "Absence")
    assert got["b2"]["pourcent_indiv_captures"] is None
    assert got["b3"]["presence"] is None and got["b4"]["n_indiv"] is None and got["b4"]["presence"] is None


def test_station_card_counts_zero_records_as_operations(spark):
    data = [("s1", "d1", "A", 0.0), ("s1", "d2", "A", 2.0), ("s1", "d2", "B", 2.0), ("s2", "d1", "B", 1.0)]
    df = spark.createDataFrame(data, "st string, d string, sp string, n double")
    stations = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "st string")
    got = {r["st"]: r.asDict() for r in PR.station_card(df, stations, "st", "d", "sp", "n", "A").collect()}
    assert (got["s1"]["n_peches"], got["s1"]["n_peches_sp_presente"], got["s1"]["n_indiv_captures_sp"]) == (2, 2, 2)
    assert (got["s1"]["pourcent_indiv_sp"], got["s1"]["presence"]) == ("50%", "Présence")
    assert (got["s2"]["n_peches_sp_presente"], got["s2"]["presence"]) == (0, "Absence")
    assert got["s3"]["presence"] is None


def test_rates_shares_and_lists(spark):
    data = [("s1", "d1", "A", 1.0), ("s1", "d2", "B", 2.0), ("s2", None, "A", 1.0), ("s3", "d1", "B", None)]
    df = spark.createDataFrame(data, "st string, d string, sp string, n double")
    rates = PR.occurrence_rates(df, {"peche": ["st", "d"], "station": ["st"]}, "sp", "A")
    assert rows(rates, "unite") == [("peche", 2, 4, "50%"), ("station", 2, 3, "67%")]
    assert tuple(PR.individual_share(df, "sp", "n", "A").first()) == (2.0, 4.0, "50%")
    codes = spark.createDataFrame([("A",), ("Z",)], "sp string")
    gone = PR.absent_everywhere(df, "sp", "n", codes)
    assert rows(gone) == [("Z", "Z : Espèce absente du périmètre de l'étude")]
    taxa = codes
    nat = spark.createDataFrame([("A", "LC")], "sp string, fr string")
    reg = spark.createDataFrame([("A", "NT")], "sp string, bzh string")
    out = PR.red_list(taxa, nat, reg, "sp", "fr", "bzh", [("Z", "LC")], {"LC": "Préoccupation mineure"})
    assert rows(out, "sp") == [("A", "Préoccupation mineure", "NT"), ("Z", None, "Préoccupation mineure")]
    trends = spark.createDataFrame([("Sh", 1.23456, "k"), ("?", 0.5, "k"), ("B", 0.1, None)], "t string, r double, k string")
    labelled = PR.trend_labels(trends, "t", "r", "k").select("t", "r", "rang")
    assert sorted(map(str, map(tuple, labelled.collect()))) == sorted(map(str, [("Stable / hausse", 1.235, 2), (None, 0.5, None)]))


def test_point_table_gathers_an_operation_once(spark):
    """One list for each operation besides the dictionary's, and its rows come from a join, not from arrays."""
    data = [(o, "complète" if o % 4 else "autre", f"s{(o * k) % 10:02}", float((o + k) % 3)) for o in range(30) for k in range(1, 5)]
    df = spark.createDataFrame(data, "op int, proto string, sp string, n double")
    vocab = spark.createDataFrame([(f"s{i:02}",) for i in range(10)], "sp string")
    out = PR.point_table(df, "op", "sp", "n", "proto", "complète", vocabulary=vocab, width=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 2 and "transform(" not in plan
    total = {}
    for op, _, sp, n in data:
        total[op, sp] = total.get((op, sp), 0.0) + n
    proto = {op: p for op, p, _, _ in data}
    want = []
    for op in range(30):
        for i in range(10):
            n = total.get((op, f"s{i:02}"), 0.0)
            rank = 3 if n > 0 else 2 if proto[op] == "complète" else 1
            want.append((op, f"s{i:02}", n, rank, PR.STATUS_LEVELS[rank - 1]))
    assert rows(out.select("op", "sp", "n", "rang", "statut")) == want
