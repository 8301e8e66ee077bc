"""Shared pieces of the operators: scratch tables, bounded slices of Arrow batches, id splits."""
from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioseek.operators.tables import scratch_dir
from folioseek.session import ensure_scratch

#: Bytes of text that a task turns into Python objects at a time (a longer single text goes alone).
SLICE_BYTES = 4 << 20


class Scratch:
    """A folder of one run in the shared folder of the cluster (`spark.checkpoint.dir`).

    Tables written here cut the plan and outlive lost executors. `drop()` deletes the folder when
    nothing reads it any more; tables that a returned DataFrame still reads are written `lasting`.
    """

    def __init__(self, spark: SparkSession, label: str):
        ensure_scratch(spark)
        self.spark = spark
        self.base = f"{scratch_dir(spark)}/folioseek-llm/{label}-{uuid.uuid4().hex}"
        self.short = f"{self.base}/short"

    def table(self, df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
        path = f"{self.base if lasting else self.short}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now: it does so when the driver collects their plans."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.short)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's text, modulo n; a null key has remainder 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def text_slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """The batches in slices of bounded text, each with its texts as UTF-8 bytes (None for null)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        if not pa.types.is_binary(values.type) and not pa.types.is_large_binary(values.type):
            values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
        start, size = 0, 0
        lengths = pa.compute.binary_length(values).fill_null(0).to_pylist()
        for at, length in enumerate(lengths):
            if at > start and size + length > SLICE_BYTES:
                yield batch.slice(start, at - start), values.slice(start, at - start).to_pylist()
                start, size = at, 0
            size += length
        yield batch.slice(start), values.slice(start).to_pylist()


def with_columns(batch: pa.RecordBatch, schema: pa.Schema, new: dict[str, object], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """The batch's columns and the new ones (lists or arrays), in the order and types of `schema`."""
    have = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in drop}
    columns = []
    for f in schema:
        x = new[f.name] if f.name in new else have[f.name]
        if not isinstance(x, (pa.Array, pa.ChunkedArray)):
            x = pa.array(x, type=f.type)
        columns.append(x if x.type == f.type else x.cast(f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a plain schema line such as 'doc_id long, text string'."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


class Memo(dict):
    """word -> value, at most `limit` entries: when it is full, the words seen first (the common ones) stay.

    Values are recomputed when a dropped word returns, so the limit bounds memory and nothing else.
    """

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def room(self, n: int) -> None:
        """Make room for n more words."""
        if len(self) + n > self.limit:
            keep = list(self.items())[: self.limit // 4]
            self.clear()
            self.update(keep)
