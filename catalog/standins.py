"""Stand-in tables and the same tables as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from creel.operators.grouping import TASK_ROWS, dealt, looked_up, many
from creel.sources.tables import materialise


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def operations(spark: SparkSession, sf: str, basin: bool = True) -> DataFrame:
    """One row per operation: id, station, date, year, protocol, surface (and basin)."""
    ops = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ope_id"),
        F.col("o_custkey").alias("code_station"),
        F.col("o_orderdate").cast("date").alias("date_peche"),
        F.year("o_orderdate").alias("annee"),
        F.col("o_orderpriority").alias("type_peche"),
        F.col("o_totalprice").alias("surface"),
    )
    if not basin:
        return ops
    places = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("code_station"), F.col("c_nationkey").alias("code_exutoire")
    )
    return ops.join(places, "code_station")


def lots(spark: SparkSession, sf: str, n: int | None = None, *, most: int = TASK_ROWS) -> DataFrame:
    """One row per catch: operation, species, count. No operation attributes.

    The parts are dealt by key to tasks for about ``most`` catches. Parts for more than four
    such tasks are looked up there; fewer are left for Spark to broadcast. ``n`` is the
    number of catches, by default counted from the files' footers.
    """
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    n = table(spark, sf, "lineitem").count() if n is None else n
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    held = table(spark, sf, "part").count() if many(parts, n, most=most) else 0
    parts = (looked_up if held > 4 * most else dealt)(parts, ["p_partkey"], max(n, held), most=most)
    return items.join(parts, items.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("ope_id"), F.col("p_brand").alias("code_espece"), F.col("l_quantity").alias("effectif")
    )


def captures(spark: SparkSession, sf: str, basin: bool = True, by_operation: bool = False, *, most: int = TASK_ROWS) -> DataFrame:
    """Catches with their operation's attributes.

    ``by_operation`` sums the catches of an operation and species before the
    operations are joined, which shrinks what that join shuffles. Both sides of the join
    are dealt by operation to tasks of about ``most`` catches, where the operations are
    looked up; what is then grouped by operation stays in these tasks. The rows are
    counted from the files' footers.
    """
    n = table(spark, sf, "lineitem").count()
    rows = lots(spark, sf, n, most=most)
    if by_operation:
        rows = rows.groupBy("ope_id", "code_espece").agg(F.sum("effectif").alias("effectif"))
    if many(rows, n, most=most):
        n = max(n, table(spark, sf, "orders").count())
    return dealt(rows, ["ope_id"], n, most=most).join(looked_up(operations(spark, sf, basin), ["ope_id"], n, most=most), "ope_id")


CAP = """cap AS (
  SELECT l_orderkey AS ope_id, o_custkey AS code_station, c_nationkey AS code_exutoire,
         p_brand AS code_espece, l_quantity AS effectif, CAST(o_orderdate AS DATE) AS date_peche,
         CAST(year(o_orderdate) AS INTEGER) AS annee, o_orderpriority AS type_peche,
         o_totalprice AS surface
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey)"""

# protocols that count as a full inventory
INVENTORY = "URGENT|HIGH|MEDIUM"


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded double, so that both engines' summation orders agree."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), digits)
    return out.alias(name or c) if name or isinstance(c, str) else out


def point_x(key: Column) -> Column:
    """Made-up coordinates of a station, from its key."""
    return ((key * 37) % 1009) / F.lit(100.0)


def point_y(key: Column) -> Column:
    return ((key * 53) % 997) / F.lit(90.0)


def level_series(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly totals of the orders as a level, with the month number as time."""
    o = table(spark, sf, "orders")
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    totals = o.groupBy(month.alias("time")).agg((F.round(F.sum("o_totalprice"), 0) / F.lit(1e6)).alias("level"))
    # the series is a prepared table: its readers go over it several times
    return materialise(totals)


SERIES = """serie AS (
  SELECT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER) AS time,
         round(sum(o_totalprice), 0) / 1e6 AS level
  FROM orders GROUP BY 1)"""
