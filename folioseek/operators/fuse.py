"""Reciprocal-rank fusion of recall lists, pinned documents, and the final cut."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import case_id_of, is_case
from ..functions.text import rounded

# --- fixed values ---
RRF_K = 60
CASE_WEIGHT, DOC_WEIGHT = 2.5, 1.0
KEY_CHARS = 80  # the opening that names a hit in the system we match; here only where a caller asks for it
DEFAULT_TOP_K, COMPLIANCE_TOP_K = 8, 12
LIST_ORDER = {"case": 1, "keyword": 2, "semantic": 3}
# --- end of fixed values ---


def effective_top_k(top_k: Column, compliance: bool = False) -> Column:
    k = F.when(top_k > 0, top_k).otherwise(DEFAULT_TOP_K).cast("int")
    return F.greatest(k, F.lit(COMPLIANCE_TOP_K)) if compliance else k


def candidate_depth(top_k: Column) -> Column:
    """Lists are longer than the result, so that second places can still win together."""
    return F.greatest(top_k * 3, F.lit(20))


def pinned_budget(top_k: Column) -> Column:
    return F.greatest(F.ceil(top_k / 3).cast("int"), F.lit(2))


def hit_key(key_chars: int | None = None) -> Column:
    """What makes two hits one: document and position, or document and the first `key_chars` of the content."""
    if key_chars is None:
        return F.concat_ws("::", "doc_id", "seq")
    return F.concat_ws("::", "doc_id", F.substring(F.coalesce("content", F.lit("")), 1, key_chars))


def ranked_lists(keyword_hits: DataFrame, semantic_hits: DataFrame | None = None) -> DataFrame:
    """All lists in one table: query_id, list, list_no, weight, rank, and the hit's columns.

    Case hits come from the same keyword recall and are ranked again among themselves.
    """
    columns = ["doc_id", "seq", "page_no", "content"]
    name = F.when(is_case(F.col("doc_id")), "case").otherwise("keyword")
    lists = keyword_hits.select("query_id", name.alias("list"), "rank", *columns)
    if semantic_hits is not None:
        lists = lists.unionByName(semantic_hits.select("query_id", F.lit("semantic").alias("list"), "rank", *columns))
    lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "list").orderBy("rank")))
    number = F.when(F.col("list") == "case", LIST_ORDER["case"]).when(F.col("list") == "keyword", LIST_ORDER["keyword"])
    return lists.withColumns(
        {
            "list_no": number.otherwise(LIST_ORDER["semantic"]),
            "weight": F.when(F.col("list") == "case", CASE_WEIGHT).otherwise(DOC_WEIGHT),
        }
    )


def fuse(lists: DataFrame, key_chars: int | None = None) -> DataFrame:
    """One row per hit key: sum of weight / (60 + rank), the lists it came from, and the first hit seen.

    Adds `rrf`, `score` (share of the query's best, 3 decimals), `sources` and `place`.
    """
    seen = F.struct("list_no", "rank")
    fused = (
        lists.withColumn("hit", hit_key(key_chars))
        .groupBy("query_id", "hit")
        .agg(
            F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("rrf"),
            F.min_by(F.struct("doc_id", "seq", "page_no", "content"), seen).alias("row"),
            F.min(seen).alias("first"),
            F.array_sort(F.collect_set(F.struct("list_no", "list"))).alias("sources"),
        )
    )
    q = Window.partitionBy("query_id")
    return fused.select(
        "query_id",
        "hit",
        "row.*",
        "rrf",
        F.transform("sources", lambda s: s["list"]).alias("sources"),
        rounded(F.col("rrf") / F.max("rrf").over(q), 3).alias("score"),
        F.row_number().over(q.orderBy(rounded(F.col("rrf"), 12).desc(), "first")).alias("place"),
    )


def pinned_rows(
    chunks: DataFrame, docs: DataFrame, queries: DataFrame, most: int | None = None, key_chars: int | None = None
) -> DataFrame:
    """The first chunks of the pinned documents, up to each query's budget: query_id, doc_id, seq, page_no, content, place.

    The opening of the pinned chunks is the same for all queries: it is taken once, to the largest
    budget, and each query slices it. Its keys are found without texts; only the texts of those, at most the
    largest budget of them, are read after, and none is shuffled.
    """
    if most is None:
        most = queries.agg(F.max(pinned_budget(F.col("top_k")))).first()[0] or 0
    pinned = docs.filter("pinned").select("doc_id")
    keys = chunks.select("doc_id", "seq").join(pinned, "doc_id", "left_semi").orderBy("doc_id", "seq").limit(most).distinct()
    head = chunks.select("doc_id", "seq", "page_no", "content").join(F.broadcast(keys), ["doc_id", "seq"], "left_semi")
    head = head.orderBy("doc_id", "seq").limit(most)
    packed = head.agg(F.array_sort(F.collect_list(F.struct("doc_id", "seq", "page_no", "content"))).alias("rows"))
    taken = queries.select(
        "query_id", F.posexplode(F.slice(packed.scalar(), 1, pinned_budget(F.col("top_k")))).alias("place", "row")
    ).select("query_id", "place", "row.*")
    once = Window.partitionBy("query_id", "hit").orderBy("place")
    return (
        taken.withColumn("hit", hit_key(key_chars)).withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n")
    )


def final_hits(queries: DataFrame, fused: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """Pinned rows first, then fused hits not among them, to top_k beyond the pinned ones.

    query_id, rank, doc_id, seq, page_no, content, score, pinned, sources, kind, case_id
    """
    columns = ["query_id", "hit", "doc_id", "seq", "page_no", "content", "score", "sources", "place"]
    rest = fused
    together = None
    if pinned is not None:
        rest = fused.join(pinned.select("query_id", "hit"), ["query_id", "hit"], "left_anti")
        together = pinned.withColumns({"score": F.lit(1.0), "sources": F.array(F.lit("pinned"))})
        together = together.select(*columns, F.lit(True).alias("pinned"))
    rest = rest.select(*columns, F.lit(False).alias("pinned"))
    rows = rest if together is None else together.unionByName(rest)
    by_pin = Window.partitionBy("query_id")
    ranked = rows.withColumns(
        {
            "rank": F.row_number().over(by_pin.orderBy(F.col("pinned").desc(), "place")),
            "n_pinned": F.count(F.when(F.col("pinned"), 1)).over(by_pin),
        }
    )
    return (
        ranked.join(queries.select("query_id", "top_k"), "query_id")
        .filter(F.col("rank") <= F.col("top_k") + F.col("n_pinned"))
        .select(
            "query_id",
            "rank",
            "doc_id",
            "seq",
            "page_no",
            "content",
            "score",
            "pinned",
            "sources",
            F.when(is_case(F.col("doc_id")) & ~F.col("pinned"), "case").otherwise("doc").alias("kind"),
            F.when(~F.col("pinned"), case_id_of(F.col("doc_id"))).alias("case_id"),
        )
    )


