"""The given tables in the shape of the data model, as DataFrames.

documents + labels  -> library documents (name, type, tags, pinned, category) and cases
benchmark           -> queries, with scope conditions and, through embeddings, query vectors
embeddings          -> vectors of first chunks          conversations -> turns
customer, orders    -> users and credentials            pages         -> URLs
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioseek.functions.classify import classify
from folioseek.functions.text import fingerprint
from folioseek.operators.cases import library_corpus
from folioseek.operators.chunk import chunk_documents
from folioseek.operators.index import KeywordIndex, scratch_index
from folioseek.operators.tables import spread
from folioseek.session import ensure_scratch

EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def minutes(n: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH) + n * 60)


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def raw_documents(spark: SparkSession, sf_dir: str, light: bool = False) -> DataFrame:
    """Documents with their labels: id, name, type, tags, pinned, category, text."""
    extension = (
        F.when(F.col("lang") == "en", ".pdf").when(F.col("lang") == "fr", ".docx").when(F.col("lang") == "de", ".md")
    ).otherwise(".txt")
    name = F.concat("source", F.lit(" "), F.upper("lang"), F.lit("-"), "doc_id", extension)
    kind = F.when(F.col("lang") == "en", "pdf").when(F.col("lang") == "fr", "word").when(F.col("lang") == "de", "md")
    category = F.when(F.col("quality") == 1, "reviewed").when(F.col("quality") == 0, "draft")
    stored = given(spark, sf_dir, "documents")
    joined = (stored if light else spread(stored)).join(given(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("doc_id").alias("number"),
        name.alias("name"),
        kind.otherwise("txt").alias("type"),
        F.array("lang", "source").alias("tags"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("pinned"),
        category.alias("category"),
        F.octet_length("text").cast("long").alias("size"),
        minutes(F.col("doc_id")).alias("created_at"),
        "lang",
        "source",
        "quality",
        "toxic",
        "text",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library documents with automatic labels and a content hash."""
    raw = raw_documents(spark, sf_dir)
    model, kind = classify(F.col("name"), F.col("text"))
    return raw.select(
        "doc_id",
        "name",
        "type",
        "tags",
        "pinned",
        model.alias("model"),
        kind.alias("kind"),
        "category",
        "size",
        F.when(F.length("text") > 0, "local").otherwise("none").alias("parse_source"),
        F.length("text").alias("chars"),
        F.lit(None).cast("int").alias("pages"),
        fingerprint(F.col("text")).alias("hash"),
        "created_at",
    )


def light_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scoping and naming need; no text is read."""
    return raw_documents(spark, sf_dir, light=True).select("doc_id", "name", "type", "tags", "pinned", "category", "created_at")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(given(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(texts(spark, sf_dir))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents read as field cases: the text is the fix, the labels are the outcome."""
    d = raw_documents(spark, sf_dir).filter(F.col("quality").isNotNull())
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    none = F.lit(None).cast("string")
    return d.select(
        F.col("doc_id").alias("case_id"),
        F.col("name").alias("title"),
        F.when(~toxic, F.col("source")).otherwise("").alias("problem"),
        F.when(F.col("lang") != "en", F.concat(F.upper("lang"), F.lit("-"), "doc_id")).alias("product"),
        F.col("lang").alias("environment"),
        F.array("doc_id").alias("doc_ids"),
        none.alias("ai_advice"),
        F.when(good, F.col("source")).alias("root_cause"),
        F.col("text").alias("final_fix"),
        F.when(good & ~toxic, "success").when(good, "partial").otherwise("fail").alias("outcome"),
        F.when(toxic, "toxic").alias("notes"),
        "tags",
        (~toxic).alias("verified"),
        F.when(good, F.col("created_at")).alias("occurred_at"),
        minutes(F.col("number") + 1440).alias("created_at"),
        none.alias("conv_id"),
        none.alias("msg_id"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages with the stored vector of the same number as their query vector."""
    v = given(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return queries(spark, sf_dir).join(v, "query_id", "left")


def scoped_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope conditions by passage: short ones ask pinned documents, long ones reviewed ones, some only English or French."""
    n = F.length("text")
    return vector_queries(spark, sf_dir).withColumns(
        {
            "only_pinned": n < 150,
            "scope_category": F.when(n > 280, "reviewed"),
            "scope_tags": F.when(F.col("text").contains("the"), F.array(F.lit("en"), F.lit("fr"))),
        }
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given vectors as the vectors of the first chunk of the document with the same number."""
    return given(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("doc_id"),
        F.lit(0).alias("seq"),
        F.lit("given").alias("model"),
        F.size("embedding").alias("dim"),
        F.col("embedding").alias("vec"),
        "label",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    return given(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"), "text")


def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with citations: each names its first source, and a second that it may not have."""
    t = turns(spark, sf_dir).filter(F.col("role") == "ai")
    text = F.concat(F.lit("[来源1]"), "text", F.lit("见[来源 2]，[来源9]。"))
    return t.select(F.concat_ws("-", "conv_id", "turn").alias("msg_id"), "conv_id", "turn", text.alias("text"))


def quoted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of each answer: the documents numbered like its conversation and like conversation + turn."""
    a = turns(spark, sf_dir).filter(F.col("role") == "ai").select("conv_id", "turn")
    number = F.explode(F.array(F.struct(F.lit(1).alias("n"), F.col("conv_id").alias("d")), F.struct(F.lit(2).alias("n"), (F.col("conv_id") + F.col("turn")).alias("d"))))
    wanted = a.select("conv_id", "turn", number.alias("q")).select("conv_id", "turn", "q.n", F.col("q.d").cast("string").alias("doc_id"))
    named = raw_documents(spark, sf_dir).select("doc_id", F.col("name").alias("doc_name"), "text")
    return wanted.join(named, "doc_id").select(
        F.concat_ws("-", "conv_id", "turn").alias("msg_id"), "conv_id", "turn", "n", "doc_id", "doc_name", F.lit("doc").alias("kind"),
        F.lit(None).cast("int").alias("page_no"), "text"
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies about labelled documents: JSON in prose, cut off for toxic drafts."""
    d = raw_documents(spark, sf_dir).filter(F.col("quality").isNotNull())

    def item(name: str, value: Column, verdict: Column) -> Column:
        return F.struct(
            F.lit(name).alias("item"), F.lit("1").alias("required"), value.alias("actual"), verdict.alias("verdict"), F.col("name").alias("source")
        )

    quality = item("quality|score", F.col("quality").cast("string"), F.when(F.col("quality") == 1, "ok").otherwise("no"))
    toxic = item("toxic", F.when(F.col("toxic") == 1, "资料未提供").otherwise("0"), F.lit("unsure"))
    model = F.when(F.col("lang") != "en", F.concat(F.upper("lang"), "doc_id")).otherwise("")
    body = F.to_json(F.struct(model.alias("model"), F.array(quality, toxic).alias("items"), F.concat(F.lit('see "'), "source", F.lit('"')).alias("conclusion")))
    broken = (F.col("quality") == 0) & (F.col("toxic") == 1)
    raw = F.concat(F.lit("结果如下：\n"), F.when(broken, F.lit('{"items": [')).otherwise(body), F.lit("\n以上。"))
    return d.select(F.col("doc_id").alias("reply_id"), raw.alias("raw"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user")
    return given(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        role.alias("role"),
        F.col("c_mktsegment").alias("note"),
        (F.col("c_acctbal") < 0).alias("disabled"),
        minutes(F.col("c_custkey")).alias("created_at"),
    )


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    secret = F.concat(F.lit("secret-"), "o_orderkey")
    return given(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.when(urgent, "api").otherwise("app").alias("kind"),
        F.col("o_orderpriority").alias("name"),
        F.sha2(secret, 256).alias("secret_hash"),
        F.substring(secret, 1, 12).alias("prefix"),
        F.lit(None).cast("timestamp").alias("last_used_at"),
        F.when(F.col("o_orderstatus") != "O", F.to_timestamp(F.date_add("o_orderdate", 365))).alias("expires_at"),
        (F.col("o_orderstatus") == "F").alias("revoked"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text as positioned spans: one page per document, a line every 14 points, slightly uneven."""
    lines = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    words = lines.select("doc_id", "line", F.posexplode(F.split("words", " ")).alias("at", "text"))
    uneven = F.when(F.length("text") > 6, 2.0).otherwise(0.0)
    y0 = F.col("line") * 14.0 + uneven
    return words.select(
        "doc_id",
        F.lit(1).alias("page"),
        (F.col("at") * 60.0).alias("x0"),
        y0.alias("y0"),
        (F.col("at") * 60.0 + F.least(F.length("text") * 6.0, F.lit(58.0))).alias("x1"),
        (y0 + 12.0).alias("y1"),
        F.lit(12.0).alias("size"),
        "text",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with their bytes; Latin-1 style names, a byte-order mark on Markdown."""
    d = raw_documents(spark, sf_dir)
    mark = F.when(F.col("lang") == "de", F.lit("\ufeff")).otherwise("")
    return d.select(
        "doc_id", "number", "name", "size", "created_at", F.encode(F.concat(mark, "text"), "UTF-8").alias("content")
    )


_INDEXES: dict[tuple, KeywordIndex] = {}


def index(spark: SparkSession, sf_dir: str, with_cases: bool = True) -> KeywordIndex:
    """The keyword index over chunks (and cases), built once per session and state of the tables' files."""
    tables = [given(spark, sf_dir, n) for n in ("documents", "labels")]
    changed = [t.agg(F.max("_metadata.file_modification_time"), F.count("*")).first() for t in tables]
    key = (spark.sparkContext.applicationId, sf_dir, with_cases, *changed)
    if key not in _INDEXES:
        ensure_scratch(spark)
        rows = chunks(spark, sf_dir)
        if with_cases:
            rows = library_corpus(rows, cases(spark, sf_dir))
        _INDEXES[key] = scratch_index(rows, "cases" if with_cases else "chunks")
    return _INDEXES[key]
