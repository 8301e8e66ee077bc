"""The document library: listings, facets, bulk edits, reclassification, name search."""
from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.classify import (
    KIND_RULES,
    MODEL_MIN_HITS,
    classify,
    first_kind,
    model_hits,
    most_frequent_first,
    part_edges,
    part_kinds,
    seam_kinds,
    seam_model,
)
from ..functions.text import clean_tags, index_tokens, null_if_blank, query_tokens, rounded, size_text
from .blocks import Scores, TermBlock, scored_in_tasks, sliced
from .tables import row_top, written

# --- fixed values ---
FACETS = ("model", "kind", "category", "tag")
SOURCE_LABEL = {"nas": "NAS解析", "local": "本地解析"}
SOURCE_NONE = "未能提取文本"
NAME_COVERAGE, NAME_HIT = 3.0, 0.2
GLOBAL_LIMIT = 30
# --- end of fixed values ---


def _tags() -> Column:
    return F.coalesce("tags", F.array().cast("array<string>"))


def is_pinned() -> Column:
    return F.coalesce("pinned", F.lit(False))


# ---- listings and facets

def newest(docs: DataFrame) -> DataFrame:
    return docs.orderBy(F.col("created_at").desc(), "doc_id")


def visible_documents(docs: DataFrame, pinned: bool = False, label: str | None = None) -> DataFrame:
    """All, pinned only, or those with a tag or model; pinned first, then newest."""
    if pinned:
        docs = docs.filter(is_pinned())
    elif label is not None:
        docs = docs.filter(F.array_contains(_tags(), label) | F.coalesce(F.col("model") == label, F.lit(False)))
    return docs.orderBy(is_pinned().desc(), F.col("created_at").desc(), "doc_id")


def facet_value(facet: str) -> Column:
    """One value per document, null when there is none; tags count by the first one."""
    if facet not in FACETS:
        raise ValueError(f"facet must be one of {FACETS}")
    value = {
        "model": F.col("model"),
        "kind": L.mapped(F.col("kind"), L.KIND_LABEL),
        "category": F.col("category"),
        "tag": F.get(_tags(), F.lit(0)),
    }[facet]
    return F.when(value != "", value)


def grouped(docs: DataFrame, facet: str) -> DataFrame:
    """Documents per facet value by name, the ungrouped last."""
    value = facet_value(facet)
    counts = docs.groupBy(F.coalesce(value, F.lit(L.UNGROUPED)).alias("label"), value.isNull().alias("ungrouped")).agg(
        F.count("*").alias("n")
    )
    return counts.orderBy("ungrouped", "label")


def unclassified_counts(docs: DataFrame) -> DataFrame:
    """Documents that automatic or typed labels could still fill; categories are the user's own and count 0."""
    return docs.agg(
        F.count_if(F.coalesce("model", F.lit("")) == "").alias("model"),
        F.count_if(F.coalesce("kind", F.lit("")) == "").alias("kind"),
        F.lit(0).cast("long").alias("category"),
        F.count_if(F.size(_tags()) == 0).alias("tag"),
    )


def category_counts(docs: DataFrame) -> DataFrame:
    """(category, n); the row with a null category counts the uncategorised."""
    category = F.when(F.col("category") != "", F.col("category"))
    return docs.groupBy(category.alias("category")).agg(F.count("*").alias("n"))


def all_tags(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(_tags()).alias("tag")).distinct().orderBy("tag")


def label_options(docs: DataFrame) -> DataFrame:
    """Tags and models that a listing can be narrowed to."""
    own = F.concat(_tags(), F.array_compact(F.array(F.when(F.col("model") != "", F.col("model")))))
    return docs.select(F.explode(own).alias("label")).distinct().orderBy("label")


def meta_line() -> Column:
    """Model, kind, size and where the text came from, in one line."""
    chars = F.when(F.coalesce("chars", F.lit(0)) > 0, F.concat(F.lit(" "), F.col("chars"), F.lit("字"))).otherwise("")
    pages = F.when(F.coalesce("pages", F.lit(0)) > 0, F.concat(F.lit(" / "), F.col("pages"), F.lit("页"))).otherwise("")
    source = F.when(F.col("parse_source").isNotNull(), L.mapped(F.col("parse_source"), SOURCE_LABEL, SOURCE_NONE))
    size = size_text(F.col("size"))
    return F.concat_ws(
        " · ",
        F.when(F.col("model") != "", F.col("model")),
        F.when(F.col("kind") != "other", L.mapped(F.col("kind"), L.KIND_LABEL)),
        F.when(size != "", size),
        F.concat(source, chars, pages),
    )


# ---- edits

def _edit(docs: DataFrame, ids: DataFrame, column: str, value: Column) -> DataFrame:
    """Set one column on the documents listed in `ids`; the others pass unchanged."""
    marked = docs.join(ids.select("doc_id").distinct().withColumn("_hit", F.lit(True)), "doc_id", "left")
    return marked.withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).select(*docs.columns)


def set_pinned(docs: DataFrame, ids: DataFrame, pinned: bool) -> DataFrame:
    return _edit(docs, ids, "pinned", F.lit(pinned))


def replace_tags(docs: DataFrame, ids: DataFrame, tags: list[str]) -> DataFrame:
    return _edit(docs, ids, "tags", clean_tags(F.array(*map(F.lit, tags)).cast("array<string>")))


def add_tags(docs: DataFrame, ids: DataFrame, tags: list[str]) -> DataFrame:
    added = clean_tags(F.array(*map(F.lit, tags)).cast("array<string>"))
    return _edit(docs, ids, "tags", F.array_union(_tags(), added))


def set_category(docs: DataFrame, ids: DataFrame, category: str) -> DataFrame:
    """One category per document; blank clears it."""
    return _edit(docs, ids, "category", null_if_blank(F.lit(category)))


def rename_document(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    return _edit(docs, ids, "name", F.lit(name))


def update_labels(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """Hand-made labels (doc_id, model, kind, category): null leaves a label, blank clears it."""
    old = docs.join(patches.select("doc_id", F.struct("model", "kind", "category").alias("_new")), "doc_id", "left")
    typed = lambda c: F.when(F.col("_new")[c].isNull(), F.col(c)).otherwise(null_if_blank(F.col("_new")[c]))
    return old.withColumns({c: typed(c) for c in ("model", "kind", "category")}).select(*docs.columns)


def rename_category(docs: DataFrame, old: str, new: str) -> DataFrame:
    """A rename reaches the documents; deleting a category leaves them as they are."""
    return docs.withColumn("category", F.when(F.col("category") == old, new).otherwise(F.col("category")))


def stale_categories(docs: DataFrame, categories: DataFrame) -> DataFrame:
    """Documents whose category is no longer in the list (column `category`)."""
    return docs.filter(F.coalesce("category", F.lit("")) != "").join(categories, "category", "left_anti")


def valid_category(name: str | None, categories: list[str]) -> str | None:
    """The category for new documents, dropped when it is not in the list any more."""
    name = (name or "").strip()
    return name if name in categories else None


def _opening(chunks: DataFrame, scan_chars: int) -> DataFrame:
    """The chunks, cut to the first `scan_chars` characters of their document.

    Chunks too far behind are left out before any shuffle: a chunk adds at least two characters to the text, and
    positions have no gaps. So a document has at most scan_chars / 2 rows in the window.
    """
    near = chunks.filter(F.col("seq") <= scan_chars // 2).withColumn("content", F.left("content", F.lit(scan_chars)))
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(scan_chars) - F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0))
    return (
        near.withColumn("room", room.cast("int"))
        .filter("room > 0")
        .select("doc_id", "seq", F.expr("left(content, room)").alias("content"))
    )


def chunk_labels(chunks: DataFrame, scan_chars: int | None = None) -> DataFrame:
    """(doc_id, model, kind) as `classify` finds them in the chunks of a document joined by line breaks.

    No row holds a document, and texts are not shuffled. Each chunk gives its model numbers, the kind rules it holds and its edges;
    edges meet by (doc_id, seq), hits are counted by (doc_id, model) with map-side sums, so a document of any length is
    spread over tasks. Positions have no gaps and chunks are not blank, as `chunk_documents` writes them.
    """
    read = chunks.select("doc_id", "seq", "content")
    if scan_chars is not None:
        read = _opening(read, scan_chars)
    content = F.col("content")
    parts = written(
        read.select("doc_id", "seq", model_hits(content).alias("models"), part_kinds(content).alias("kinds"), part_edges(content).alias("edge")),
        "parts",
    )
    # a part is first, second and third at the seams behind itself, the part before and the one before that
    places = F.explode(F.array(*[F.struct((F.col("seq") - i).alias("at"), F.lit(i).alias("place")) for i in range(3)])).alias("p")
    at = [F.max(F.when(F.col("p.place") == i, F.col("edge"))).alias(f"e{i}") for i in range(3)]
    seams = (
        parts.select("doc_id", "edge", places)
        .groupBy("doc_id", F.col("p.at").alias("seq"))
        .agg(*at)
        .filter("e0 is not null and e1 is not null")
        .select(
            "doc_id",
            "seq",
            seam_model(F.col("e0"), F.col("e1")).alias("model"),
            seam_kinds(F.col("e0"), F.col("e1"), F.col("e2")).alias("kinds"),
        )
    )
    inside = parts.select("doc_id", "seq", F.posexplode("models").alias("place", "model"))
    across = seams.filter("model is not null").select("doc_id", "seq", F.lit(2**31 - 1).alias("place"), "model")
    counted = inside.unionByName(across).groupBy("doc_id", "model").agg(
        F.count("*").alias("n"), F.min(F.struct("seq", "place")).alias("first")
    )
    early = F.struct((-F.col("first.seq")).alias("seq"), (-F.col("first.place")).alias("place")).alias("early")
    ranked = counted.groupBy("doc_id").agg(F.max(F.struct("n", early, "model")).alias("best"))
    rules = range(len(KIND_RULES))
    kinds = parts.select("doc_id", "kinds").unionByName(seams.select("doc_id", "kinds"))
    kinds = kinds.groupBy("doc_id").agg(*[F.bool_or(F.get("kinds", F.lit(i))).alias(f"k{i}") for i in rules])
    return kinds.join(ranked, "doc_id", "left").select(
        "doc_id",
        most_frequent_first(F.col("best"), MODEL_MIN_HITS).alias("model"),
        first_kind([F.col(f"k{i}") for i in rules]).alias("kind"),
    )


def reclassified(
    docs: DataFrame, chunks: DataFrame | None, fill_only: bool = False, scan_chars: int | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """Model and kind again from the stored chunks: their whole text, or its first `scan_chars` characters.

    `fill_only` keeps labels that are set; otherwise a new label wins and an old one stays where nothing was found.
    `labels` are the `chunk_labels` of the chunks, where they were made before.
    """
    labels = chunk_labels(chunks, scan_chars) if labels is None else labels
    by_text = labels.select("doc_id", F.col("model").alias("_text_model"), F.col("kind").alias("_text_kind"))
    name_model, name_kind = classify(F.col("name"), F.lit(""), scan_chars)
    found = docs.join(by_text, "doc_id", "left").withColumns(
        {"_model": F.coalesce(name_model, "_text_model"), "_kind": F.coalesce(name_kind, "_text_kind")}
    )
    first, second = ("", "_") if fill_only else ("_", "")
    return found.withColumns(
        {c: F.coalesce(f"{first}{c}", f"{second}{c}") for c in ("model", "kind")}
    ).select(*docs.columns)


# ---- search over names, and over everything

def _name_scores(queries: pa.Table) -> Scores:
    terms = TermBlock(queries["terms"].combine_chunks())
    asked = np.asarray(pc.list_value_length(queries["terms"].combine_chunks()))[:, None]

    def score(batch: pa.RecordBatch, floor: np.ndarray) -> np.ndarray:
        hits = terms.scores(batch.column("tokens"), lambda row, count: np.ones(len(row)))
        return hits / asked * NAME_COVERAGE + hits * NAME_HIT

    return sliced(score, len(queries))


def name_search(docs: DataFrame, queries: DataFrame, limit: int = GLOBAL_LIMIT) -> DataFrame:
    """Documents whose name holds query tokens: 3 x share of the query covered + 0.2 x tokens hit.

    Names share words ("pdf"), so they are scored in their tasks, as chunks are.
    """
    weighted = F.transform(query_tokens(F.col("text")), lambda w: F.struct(w.alias("term"), F.lit(1.0).alias("weight")))
    asked = queries.select("query_id", weighted.alias("terms")).filter(F.size("terms") > 0)
    rows = docs.select("doc_id", "created_at", index_tokens(F.col("name")).alias("tokens"))
    order = [("created_at", "descending"), ("doc_id", "ascending")]
    keep = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "created_at")}
    found = scored_in_tasks(rows, asked, _name_scores, keep, limit, order).withColumnRenamed("raw", "score")
    best = [rounded(F.col("score"), 9).desc(), F.col("created_at").desc(), F.col("doc_id")]
    return row_top(found, ["query_id"], best, limit)


def search_all(
    docs: DataFrame, names: DataFrame, queries: DataFrame, keyword_hits: DataFrame, limit: int = GLOBAL_LIMIT
) -> DataFrame:
    """Names and texts in one list: query_id, rank, kind doc/chunk/case, doc_id, doc_name, page_no, snippet, score.

    `names` are the document and case names; `keyword_hits` is `keyword_search` to the same limit.
    """
    by_name = (
        name_search(docs, queries, limit)
        .join(docs.select("doc_id", F.concat(F.upper(F.coalesce("type", F.lit(""))), F.lit(" 文档")).alias("snippet")), "doc_id")
        .select(
            "query_id",
            F.lit("doc").alias("kind"),
            "doc_id",
            F.lit(None).cast("int").alias("page_no"),
            "snippet",
            "score",
            F.lit(0).alias("part"),
            F.col("rank").alias("place"),
        )
    )
    case = L.is_case(F.col("doc_id"))
    by_text = keyword_hits.select(
        "query_id",
        F.when(case, "case").otherwise("chunk").alias("kind"),
        "doc_id",
        F.when(~case, F.col("page_no")).alias("page_no"),
        F.col("content").alias("snippet"),
        "score",
        F.lit(1).alias("part"),
        F.col("rank").alias("place"),
    )
    order = [rounded(F.col("score"), 9).desc(), F.col("part"), F.col("place")]
    top = row_top(by_name.unionByName(by_text), ["query_id"], order, limit)
    return top.join(names.select("doc_id", F.col("name").alias("doc_name")), "doc_id", "left").select(
        "query_id",
        "rank",
        "kind",
        "doc_id",
        F.coalesce("doc_name", F.lit(L.DELETED_NAME)).alias("doc_name"),
        "page_no",
        "snippet",
        "score",
    )
