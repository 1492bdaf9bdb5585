"""Every registered query at the smallest scale, against its SQL where it has one."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import standins
from tools.check import TABLES, canon

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_query(spark, duck, key):
    got = entry.queries()[key](spark, SF).toPandas()
    sql = entry.oracle_sql().get(key)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got).equals(canon(want))


def test_entry(spark):
    assert entry.entry(spark).columns == ["ope_id", "richesse", "shannon", "simpson", "pielou"]


@pytest.mark.parametrize("key", ["div_indices_site", "est_pool_point", "win_latest_ties", "lm_table", "samp_n"])
def test_result_does_not_depend_on_partitions(spark, key):
    frames = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        frames.append(canon(entry.queries()[key](spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert frames[0].equals(frames[1])


def test_captures_are_dealt_by_operation(spark, tmp_path):
    """What queries group by operation lies in tasks whose size does not grow with the table."""
    n = 3000
    spark.range(n).selectExpr("id div 3 AS l_orderkey", "id % 7 AS l_partkey", "double(id % 50) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(7).selectExpr("id AS p_partkey", "concat('Brand#', id) AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    order = ["id AS o_orderkey", "id % 10 AS o_custkey", "timestamp'1997-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority", "1.0D AS o_totalprice"]
    spark.range(n // 3).selectExpr(*order).write.parquet(f"{tmp_path}/orders.parquet")
    whole, dealt = (standins.captures(spark, str(tmp_path), basin=False, **kw) for kw in ({}, {"most": 100}))
    sizes = dealt.groupBy("ope_id", F.spark_partition_id().alias("p")).count()
    assert sizes.count() == n // 3
    assert sizes.groupBy("p").agg(F.sum("count").alias("n")).agg(F.max("n"), F.count("*")).first()[0] < 2 * 100
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect()))


def test_catches_meet_their_parts_in_dealt_tasks(spark, tmp_path):
    """Parts too many to broadcast are joined in tasks whose size does not grow with the table."""
    n = 3000
    spark.range(n).selectExpr("id div 3 AS l_orderkey", "if(id % 50 = 0, NULL, id % 1000) AS l_partkey", "double(id % 50) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    # a key twice, a null key, and keys that no catch has
    spark.range(1200).selectExpr("if(id = 1100, NULL, if(id = 1150, 7, id)) AS p_partkey", "concat('Brand#', id % 9) AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    want = sorted(map(tuple, standins.lots(spark, str(tmp_path)).collect()))
    assert len(want) == n - n // 50 + 3
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = standins.lots(spark, str(tmp_path), most=100)
        sizes = dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(sizes) > 20 and max(r["count"] for r in sizes) < 2 * 100
        assert sorted(map(tuple, dealt.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert sorted(map(tuple, standins.lots(spark, str(tmp_path), most=100).collect())) == want


def test_tasks_do_not_sort_the_catches_of_one_part_or_operation(spark, tmp_path, capsys):
    """Half of the catches have one part, half one operation; a sorted join would hold them in one task."""
    n = 3000
    catch = ["if(id % 4 < 2, 7, id div 3) AS l_orderkey", "if(id % 50 = 0, NULL, if(id % 4 IN (1, 2), 7, id % 1000)) AS l_partkey", "double(id % 50) AS l_quantity"]
    spark.range(n).selectExpr(*catch).write.parquet(f"{tmp_path}/lineitem.parquet")
    # keys twice, null keys, and keys that no catch has
    spark.range(1200).selectExpr("if(id = 1100, NULL, if(id = 1150, 7, id)) AS p_partkey", "concat('Brand#', id % 9) AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    order = ["if(id = 1, NULL, if(id = 2, 9, id)) AS o_orderkey", "id % 10 AS o_custkey", "timestamp'1997-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority", "1.0D AS o_totalprice"]
    # more operations than catches: these decide how many tasks there are
    spark.range(2 * n).selectExpr(*order).write.parquet(f"{tmp_path}/orders.parquet")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole, dealt = (standins.captures(spark, str(tmp_path), basin=False, **kw) for kw in ({}, {"most": 100}))
        dealt.explain()
        plan = capsys.readouterr().out
        assert plan.count("ShuffledHashJoin") == 2 and "Sort" not in plan
        assert f", {2 * n // 100})" in plan
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect()))
        few = standins.lots(spark, str(tmp_path), most=500)  # parts for less than four tasks
        few.explain()
        assert "ShuffledHashJoin" not in capsys.readouterr().out
        assert few.count() == standins.lots(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
