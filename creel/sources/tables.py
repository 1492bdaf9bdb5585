"""Readers of delimited files, prepared tables, snapshots and layers; the table writer."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one all executors share, removed when the application ends.

    The cluster names it in ``spark.checkpoint.dir``; where that is not set, the
    folder lies under the warehouse, which is shared as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    local = base.startswith("file:") or "://" not in base
    if local and not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir; the warehouse is on this machine only")
    path = f"{base.rstrip('/')}/creel-{uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate table once to the shared folder and read it back.

    For a table that is expensive and read more than once. Unlike a cache it does
    not depend on an executor staying alive.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: str | StructType,
    sep: str = "\t",
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Delimited text with a header. The schema is stated, so no pass infers it."""
    df = spark.read.schema(schema).csv(path, sep=sep, header=True, enforceSchema=False)
    return df.withColumnsRenamed(dict(rename)) if rename else df


def read_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Prepared tables by name."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def latest_snapshot(spark: SparkSession, folder: str, pattern: str, by: str = "name") -> str:
    """Path of the newest entry of a folder whose name matches the pattern.

    Newest by name (dated names sort) or by modification time; a folder is as new as
    the newest entry directly in it. The folder's own entries are listed, not what lies
    below them, and no file is read. Equal times are decided by name; hidden entries
    (with a leading dot or underscore) do not count.
    """
    if by not in ("name", "modified"):
        raise ValueError(f"unknown order {by!r}")
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())

    def newest(entry) -> int:
        inside = store.listStatus(entry.getPath()) if entry.isDirectory() else []
        return max([entry.getModificationTime(), *[e.getModificationTime() for e in inside]])

    entries = [(e.getPath().getName(), e) for e in store.listStatus(place)]
    fitting = [(n, e) for n, e in entries if n[0] not in "._" and re.search(pattern, n)]
    if not fitting:
        raise FileNotFoundError(f"nothing in {folder} matches {pattern!r}")
    found = max((0 if by == "name" else newest(e), n) for n, e in fitting)[1]
    return f"{folder.rstrip('/')}/{found}"


def read_latest(spark: SparkSession, folder: str, pattern: str, by: str = "name") -> DataFrame:
    return spark.read.parquet(latest_snapshot(spark, folder, pattern, by))


def read_layer(spark: SparkSession, path: str, attributes: Mapping[str, str], rings: str = "rings") -> DataFrame:
    """Exported polygon layer: renamed attributes plus the ring array."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(old).alias(new) for new, old in attributes.items()], F.col(rings))


def read_points(spark: SparkSession, path: str, attributes: Mapping[str, str], x: str, y: str) -> DataFrame:
    """Exported point layer: renamed attributes plus two coordinates."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(old).alias(new) for new, old in attributes.items()], F.col(x), F.col(y))


def sheet_rows(df: DataFrame, condition: Column, columns: Mapping[str, str]) -> DataFrame:
    """Rows of a list that meet a condition, columns renamed."""
    return df.where(condition).select(*[F.col(old).alias(new) for new, old in columns.items()])


def write_tables(
    tables: Mapping[str, DataFrame], folder: str, partition_by: Mapping[str, Sequence[str]] | None = None
) -> dict[str, str]:
    """Save named result tables as Parquet; returns their paths.

    Partitioned tables are rebalanced on the partition columns before they are
    written: a large year is cut into several files of a fair size, small ones are
    not scattered over all tasks.
    """
    partition_by = partition_by or {}
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}.parquet"
        cols = list(partition_by.get(name, ()))
        if cols:
            df.hint("rebalance", *cols).write.mode("overwrite").partitionBy(*cols).parquet(paths[name])
        else:
            df.write.mode("overwrite").parquet(paths[name])
    return paths
