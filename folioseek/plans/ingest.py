"""Import: files to text, copies out by content, labels, chunks."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import classify
from ..functions.text import fingerprint, rounded
from ..operators.chunk import chunk_documents
from ..operators.tables import written

# --- fixed values ---
SYNC_TAG, SYNC_SOURCE = "NAS", "nas"
NO_TEXT_NOTE = "未能提取到文本"
# --- end of fixed values ---


def first_copies(files: DataFrame, library: DataFrame | None, order: list[Column]) -> DataFrame:
    """Files whose content is new: `is_new` is false for copies of the library or of an earlier file.

    `files` needs doc_id and hash. A file without text has no hash; it is kept and never compared.
    Only (hash, doc_id) rows are grouped, and a content with very many copies combines map-side; all
    joins are on unique keys. The copies found, not the texts, are joined back.
    """
    keyed = files.filter(F.col("hash").isNotNull()).select("hash", "doc_id", *order)
    first = keyed.groupBy("hash").agg(F.min_by("doc_id", F.struct(*order, "doc_id")).alias("doc_id"))
    if library is not None:
        first = first.join(library.filter(F.col("hash").isNotNull()).select("hash").distinct(), "hash", "left_anti")
    copies = keyed.select("doc_id").join(first.select("doc_id"), "doc_id", "left_anti")
    marked = written(copies.withColumn("_new", F.lit(False)), "copies")
    return files.join(marked, "doc_id", "left").withColumn("is_new", F.coalesce("_new", F.lit(True))).drop("_new")


@dataclass
class Import:
    """What an import adds and reports."""

    documents: DataFrame
    chunks: DataFrame
    failures: DataFrame
    counts: DataFrame


def labelled(files: DataFrame, category: str | None) -> DataFrame:
    """Parsed files (doc_id, name, type, size, text, source, quality, pages, note, hash, created_at) as documents."""
    model, kind = classify(F.col("name"), F.coalesce("text", F.lit("")))
    return files.select(
        "doc_id",
        "name",
        "type",
        F.array().cast("array<string>").alias("tags"),
        F.lit(False).alias("pinned"),
        F.when(F.col("text").isNotNull(), "indexed").otherwise("partial").alias("status"),
        model.alias("model"),
        kind.alias("kind"),
        F.lit(category).cast("string").alias("category"),
        "size",
        F.col("source").alias("parse_source"),
        rounded(F.col("quality"), 2).alias("parse_quality"),
        "pages",
        F.coalesce(F.length("text"), F.lit(0)).alias("chars"),
        "note",
        "hash",
        "created_at",
    )


def _marked(parsed: DataFrame, library: DataFrame | None, order: list[Column]) -> DataFrame:
    """Parsed files with hash and is_new. Texts are written once: they are deduplicated, labelled and chunked from there."""
    return first_copies(written(parsed.withColumn("hash", fingerprint(F.col("text"))), "parsed"), library, order)


def _failures(files: DataFrame) -> DataFrame:
    reason = F.concat("name", F.lit("："), F.coalesce("note", F.lit(NO_TEXT_NOTE)))
    return files.filter(F.col("text").isNull()).select("doc_id", "name", reason.alias("reason"))


def import_files(
    parsed: DataFrame, library: DataFrame | None, order: list[Column], category: str | None = None
) -> Import:
    """One import pass over routed files (sources.files.routed plus doc_id and created_at).

    `library` holds the hashes already there.
    """
    marked = _marked(parsed, library, order)
    fresh = marked.filter("is_new")
    counts = marked.agg(
        F.count_if(F.col("is_new")).alias("added"),
        F.count_if(~F.col("is_new")).alias("skipped"),
        F.count_if(F.col("is_new") & F.col("text").isNull()).alias("failed"),
    )
    return Import(labelled(fresh, category), chunk_documents(fresh), _failures(fresh), counts)


def sync_files(
    parsed: DataFrame, library: DataFrame | None, order: list[Column], category: str | None = None
) -> Import:
    """Folder sync: as an import, but files without text are not added; they are reported and counted. Documents are tagged."""
    marked = _marked(parsed, library, order)
    readable = F.col("text").isNotNull()
    fresh = marked.filter(F.col("is_new") & readable)
    counts = marked.agg(
        F.count_if(F.col("is_new") & readable).alias("added"),
        F.count_if(~F.col("is_new")).alias("skipped"),
        F.count_if(~readable).alias("unreadable"),
    )
    tagged = labelled(fresh, category).withColumns({"tags": F.array(F.lit(SYNC_TAG)), "source": F.lit(SYNC_SOURCE)})
    return Import(tagged, chunk_documents(fresh), _failures(marked), counts)
