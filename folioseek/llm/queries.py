"""The registered queries: each applies one operator, with production parameters, to its whole table."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioseek.llm import bpe, decontaminate, filter_audit, hard_negatives, html_text, jaccard, lines, quality, shards, simhash, surrogates, token_store, toxicity
from folioseek.llm.common import Scratch, crc_mod, given
from folioseek.llm.sql import SQL  # noqa: F401
from folioseek.operators.tables import scratch_dir
from folioseek.session import ensure_scratch

TOKENIZER = "word_bpe_49k.json"
#: The key of the registered queries; a deployment passes its own.
SURROGATE_KEY = b"folioseek surrogates"
TOXIC_FROM, GOOD_FROM = 0.3, 0.5


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(given(spark, sf_dir, "documents")).drop("removed")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_scratch(spark)
    docs = given(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}/folioseek-llm/store-{uuid.uuid4().hex}"
    store = token_store.write_tokens(docs, folder, tokenizer_path())
    keys = docs.select(token_store.key_column("doc_id").alias("key")).distinct()
    rows = token_store.read_tokens(store, token_store.find_keys(store, keys))
    return rows.withColumnRenamed("key", "doc_id")


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learnt from."""
    return given(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 4) != 2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, toxicity_labels(spark, sf_dir))
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    predicted = (F.col("score") >= TOXIC_FROM).cast("int")
    return toxicity.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = given(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_main_text(pages)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_encode(docs, tokenizer_path(), results=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, SURROGATE_KEY)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontaminate.scan_benchmark(docs, given(spark, sf_dir, "benchmark"))
    return scanned.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(given(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents").select("doc_id", "text")
    statistics = Scratch(spark, "quality").table(quality.document_statistics(docs), "statistics", lasting=True)
    labels = given(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 3) != 1)
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    predicted = (F.col("score") >= GOOD_FROM).cast("int")
    scored = quality.score(statistics, quality.train(statistics, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.balanced_shards(given(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(given(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(given(spark, sf_dir, "documents"), given(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = given(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", "embedding", moved.alias("label")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_frequency, op2_token_store, op3_toxicity, op4_html_text, op5_bpe,
        op6_surrogates, op7_decontaminate, op8_jaccard, op9_quality, op10_shards,
        op11_simhash, op12_filter_audit, op13_hard_negatives,
    )
}
