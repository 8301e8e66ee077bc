"""Repeated folder sync as a stream: every run adds only files whose content is new.

A synced table holds, below one folder,

documents, chunks   rows with the sync_id, batch_id and write_id of the attempt that wrote them
marks               one row per finished attempt, written last

A sync_id belongs to one checkpoint and is stored beside it, so batch numbers of different checkpoints never
meet, and a lost checkpoint begins a new sync. Rows are appended, never overwritten; of the
attempts at a batch only the one that was marked last counts, also where it added nothing. `synced` reads
through the marks.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import scratch, spread
from ..plans.ingest import sync_files
from ..sources.files import Extractor, routed, with_names

FILES = "path string, modificationTime timestamp, length bigint, content binary"
KEYS = "sync_id string, batch_id bigint, write_id string"
MARKS = f"{KEYS}, attempt bigint, unreadable bigint"
LIBRARY_HASHES = f"doc_id string, hash string, {KEYS}"


def _stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table, or None where nothing was written yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def sync_id_of(spark: SparkSession, checkpoint: str) -> str:
    """The id kept beside a checkpoint; a new checkpoint gets a new one."""
    path = f"{checkpoint.rstrip('/')}/sync-id"
    kept = _stored(spark, path, "sync_id string")
    if kept is None:
        spark.createDataFrame([(uuid.uuid4().hex,)], "sync_id string").write.mode("ignore").parquet(path)
        kept = _stored(spark, path, "sync_id string")
    return kept.first()["sync_id"]


def finished(spark: SparkSession, table: str) -> DataFrame:
    """(sync_id, batch_id, write_id, unreadable): the attempt that counts for each batch."""
    marks = _stored(spark, f"{table}/marks", MARKS)
    if marks is None:
        marks = spark.createDataFrame([], MARKS)
    last = marks.groupBy("sync_id", "batch_id").agg(F.max_by(F.struct("write_id", "unreadable"), F.struct("attempt", "write_id")).alias("m"))
    return last.select("sync_id", "batch_id", "m.write_id", "m.unreadable")


def synced(spark: SparkSession, table: str, name: str) -> DataFrame | None:
    """The rows of `documents`, `chunks` or `unreadable` that finished batches added; None before any were."""
    rows = _stored(spark, f"{table}/{name}")
    return rows if rows is None else rows.join(finished(spark, table).select("write_id"), "write_id", "left_semi")


def library_hashes(spark: SparkSession, table: str, sync_id: str, batch_id: int) -> DataFrame:
    """Hashes in the library, without those of the batch that is being written again."""
    rows = _stored(spark, f"{table}/documents", LIBRARY_HASHES)
    if rows is None:
        return spark.createDataFrame([], LIBRARY_HASHES)
    others = finished(spark, table).filter((F.col("sync_id") != sync_id) | (F.col("batch_id") != batch_id))
    return rows.join(others.select("write_id"), "write_id", "left_semi")


def add_batch(
    files: DataFrame,
    batch_id: int,
    table: str,
    sync_id: str,
    make_extractor: Callable[[], Extractor] | None = None,
    category: str | None = None,
) -> None:
    """Dedupe, label, chunk and store one batch, then mark it. A repeated batch replaces what it added before."""
    with scratch(files.sparkSession):
        _add_batch(files, batch_id, table, sync_id, make_extractor, category)


def _add_batch(
    files: DataFrame,
    batch_id: int,
    table: str,
    sync_id: str,
    make_extractor: Callable[[], Extractor] | None,
    category: str | None,
) -> None:
    spark = files.sparkSession
    parsed = (
        routed(with_names(spread(files)), make_extractor)
        .withColumn("doc_id", F.sha2("path", 256))
        .withColumn("created_at", F.col("modificationTime"))
    )
    known = library_hashes(spark, table, sync_id, batch_id)
    done = sync_files(parsed, known, [F.col("modificationTime"), F.col("path")], category)
    write_id = uuid.uuid4().hex
    keys = {"sync_id": F.lit(sync_id), "batch_id": F.lit(batch_id).cast("bigint"), "write_id": F.lit(write_id)}
    for name, rows in (("chunks", done.chunks), ("documents", done.documents), ("unreadable", done.failures)):
        rows.withColumns(keys).write.mode("append").partitionBy("sync_id", "batch_id").parquet(f"{table}/{name}")
    marks = _stored(spark, f"{table}/marks", MARKS)
    mine = None if marks is None else marks.filter((F.col("sync_id") == sync_id) & (F.col("batch_id") == batch_id))
    attempt = 0 if mine is None else mine.count()
    unreadable = done.counts.first()["unreadable"]
    mark = spark.createDataFrame([(sync_id, batch_id, write_id, attempt, unreadable)], MARKS)
    mark.coalesce(1).write.mode("append").parquet(f"{table}/marks")


def sync_stream(
    files: DataFrame,
    table: str,
    checkpoint: str,
    make_extractor: Callable[[], Extractor] | None = None,
    category: str | None = None,
) -> StreamingQuery:
    """Take in what a stream of files (path, modificationTime, length, content) holds now, then stop.

    The checkpoint remembers files; the hashes in the library remember contents. No state grows with
    the stream. Any number of folders, each with its own checkpoint, can be synced into one table.
    """
    sync_id = sync_id_of(files.sparkSession, checkpoint)
    return (
        files.writeStream.foreachBatch(lambda rows, n: add_batch(rows, n, table, sync_id, make_extractor, category))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def sync_folder(
    spark: SparkSession, folder: str, table: str, checkpoint: str, files_per_batch: int = 10_000, **options
) -> StreamingQuery:
    """Sync a folder of plain and binary files; see `sync_stream` for the options."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return sync_stream(files, table, checkpoint, **options)
