"""Keyed tables on disk: a save or a deletion rewrites only the buckets it touches.

A table is a folder of

rows/<write>/bucket=<n>   Parquet files of one bucket as one write left it, never changed afterwards
manifest/<version>.json   columns, bucketing, and for each bucket the write that holds it

Rows are dealt to buckets by hash of the `by` columns. A write reads the buckets its keys fall in, writes them anew and then
commits the next version by renaming its manifest there, which fails where another writer was first. If that
writer changed other buckets only, the manifest is made again on top of its version; otherwise the whole write is. So
readers see whole versions, no write is lost, and a writer that dies leaves files that no manifest names.

Empty tables and buckets have no files. Null keys are keys like any other in the bucketing; `upsert` keeps base rows with them.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .tables import scratch, upsert, written

BUCKET = "__bucket__"


@dataclass(frozen=True)
class Version:
    """One committed state: which write holds each bucket that has rows."""

    number: int
    by: list[str]
    buckets: int
    schema: StructType
    holds: dict[int, str]

    def text(self) -> str:
        holds = {str(b): w for b, w in sorted(self.holds.items())}
        return json.dumps({"by": self.by, "buckets": self.buckets, "schema": self.schema.jsonValue(), "holds": holds})


class _Folder:
    """The few file operations that a commit needs, by the store's own client."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.base = spark, path.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, below: str):
        return self.hadoop.Path(f"{self.base}/{below}" if below else self.base)

    def names(self, below: str) -> list[str]:
        at = self.path(below)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def commit(self, below: str, text: str) -> bool:
        """Put a whole new file there; False where one is already."""
        own = self.path(f"manifest/.{uuid.uuid4().hex}")
        out = self.fs.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = self.path(below)
        files = self.hadoop.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            files.rename(self.fs.makeQualified(own), self.fs.makeQualified(target), none)
        except Py4JJavaError as failed:
            self.fs.delete(own, False)
            if "FileAlreadyExistsException" not in failed.java_exception.getClass().getName():
                raise
            return False
        return True


def current(spark: SparkSession, path: str) -> Version | None:
    """The last committed version, None before the first."""
    names = [n for n in _Folder(spark, path).names("manifest") if n.endswith(".json") and not n.startswith(".")]
    if not names:
        return None
    name = max(names)
    kept = json.loads(spark.read.text(f"{path.rstrip('/')}/manifest/{name}", wholetext=True).first()[0])
    holds = {int(b): w for b, w in kept["holds"].items()}
    return Version(int(name[:-5]), kept["by"], kept["buckets"], StructType.fromJson(kept["schema"]), holds)


def _bucket(version: Version) -> Column:
    return F.pmod(F.xxhash64(*version.by), F.lit(version.buckets)).cast("int")


def _rows(spark: SparkSession, path: str, version: Version, buckets: list[int] | None = None) -> DataFrame:
    wanted = version.holds if buckets is None else {b: version.holds[b] for b in buckets if b in version.holds}
    if not wanted:
        return spark.createDataFrame([], version.schema)
    files = [f"{path.rstrip('/')}/rows/{write}/{BUCKET}={b}" for b, write in sorted(wanted.items())]
    return spark.read.schema(version.schema).parquet(*files)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last version."""
    version = current(spark, path)
    if version is None:
        raise ValueError(f"no table at {path}")
    return _rows(spark, path, version)


def _write(path: str, version: Version, rows: DataFrame) -> dict[int, str]:
    """Write rows to their buckets; the rebalancing splits a bucket that is much larger than others over tasks."""
    write = uuid.uuid4().hex
    dealt = rows.withColumn(BUCKET, _bucket(version)).hint("rebalance", BUCKET)
    dealt.write.partitionBy(BUCKET).parquet(f"{path.rstrip('/')}/rows/{write}")
    names = _Folder(rows.sparkSession, path).names(f"rows/{write}")
    return {int(n.split("=")[1]): write for n in names if n.startswith(f"{BUCKET}=")}


def _commit(spark: SparkSession, path: str, version: Version) -> bool:
    return _Folder(spark, path).commit(f"manifest/{version.number:012d}.json", version.text())


def create_table(rows: DataFrame, path: str, by: list[str], buckets: int) -> Version:
    """Store `rows` as the first version; choose `buckets` for some hundred MB each."""
    spark = rows.sparkSession
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema])
    version = Version(0, by, buckets, schema, {})
    version = replace(version, holds=_write(path, version, rows))
    if not _commit(spark, path, version):
        raise ValueError(f"there is a table at {path}")
    return version


def _rewrite(spark: SparkSession, path: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> Version:
    """Replace the buckets of `keys` by `change` of their rows, as one new version."""
    base = done = None
    while True:
        now = current(spark, path)
        if now is None:
            raise ValueError(f"no table at {path}")
        if base is None or any(now.holds.get(b) != base.holds.get(b) for b in touched):
            base = now
            touched = sorted(r[0] for r in keys.select(_bucket(base)).distinct().collect())  # at most `buckets` numbers
            if not touched:
                return base
            done = _write(path, base, change(_rows(spark, path, base, touched)).select(*base.schema.names))
        kept = {b: w for b, w in now.holds.items() if b not in set(touched)}
        new = replace(now, number=now.number + 1, holds=kept | done)
        if _commit(spark, path, new):
            return new


def upsert_table(path: str, updates: DataFrame, keys: list[str], order: list[Column] | None = None) -> Version:
    """Save rows by key into the table, as `upsert` does; `keys` hold the table's `by` columns."""
    spark = updates.sparkSession
    with scratch(spark):
        fresh = written(updates, "updates")
        return _rewrite(spark, path, fresh, lambda rows: upsert(rows, fresh, keys, order))


def delete_from_table(path: str, ids: DataFrame, key: str) -> Version:
    """Drop the rows whose `key` is in `ids`; the table's rows are dealt by `key`."""
    spark = ids.sparkSession
    version = current(spark, path)
    if version is None or version.by != [key]:
        raise ValueError(f"no table dealt by {key} at {path}")
    with scratch(spark):
        kind = version.schema[key].dataType
        gone = written(ids.select(F.col(key).cast(kind).alias(key)).distinct(), "ids")
        return _rewrite(spark, path, gone, lambda rows: rows.join(gone, key, "left_anti"))
