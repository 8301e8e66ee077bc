"""Keyed tables: upsert, cascading delete, first-seen dedupe, and scratch tables."""
from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class _Scopes(threading.local):
    """The open scratch scopes of a thread: streams and writers of other threads have their own."""

    def __init__(self):
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder for one scratch table, deleted with the innermost `scratch` scope."""
    path = f"{scratch_dir(spark)}/folioseek/{label}-{uuid.uuid4().hex}"
    if _SCOPES.open:
        _SCOPES.open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside are deleted at the end: what reads them has to be stored or gathered inside."""
    paths: list[str] = []
    _SCOPES.open.append(paths)
    try:
        yield
    finally:
        _SCOPES.open.remove(paths)
        jvm = spark.sparkContext._jvm
        for path in paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write `df` once as Parquet in the scratch folder and read it back.

    This cuts the plan at a place that is used several times and outlives lost executors. It is also
    the size check for broadcasts: the table's real size is known when the next join is planned, so
    no join here carries a broadcast hint for data that could grow.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of fewer splits than cores; an input of many splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def latest(updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key in `order`. An aggregate, so a hot key combines map-side."""
    rest = [c for c in updates.columns if c not in keys]
    return (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
        .select(*keys, "row.*")
        .select(*updates.columns)
    )


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in `order`."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
        .select(*keys, "row.*")
        .select(*df.columns)
    )


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Save by key, last write wins. Give `order` when `updates` may repeat a key."""
    fresh = latest(updates, keys, order) if order else updates
    kept = base.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh.select(*base.columns))


def delete_cascade(ids: DataFrame, tables: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Drop the rows of every table whose `key` is in `ids` (documents with chunks and vectors, users with credentials)."""
    gone = ids.select(key).distinct()
    return {name: t.join(gone, key, "left_anti") for name, t in tables.items()}


def with_name(rows: DataFrame, names: DataFrame, key: str, name: str, fallback: str) -> DataFrame:
    """Late name lookup: renames show at once, a deleted owner reads as `fallback`."""
    return rows.join(names.select(key, name), key, "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(fallback))
    )


def row_top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Top `k` per group; the row_number filter lets each task cut its own rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
