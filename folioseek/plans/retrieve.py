"""Hybrid retrieval for a table of queries, from index and vectors to final hits."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fuse import (
    candidate_depth,
    effective_top_k,
    final_hits,
    fuse,
    pinned_budget,
    pinned_rows,
    ranked_lists,
)
from ..operators.index import KeywordIndex
from ..operators.keyword import keyword_search
from ..operators.scope import Scope, restricted, with_scope
from ..operators.semantic import semantic_search, vector_rows
from ..operators.tables import written
from ..functions.text import blank


def hybrid_retrieve(
    index: KeywordIndex,
    docs: DataFrame,
    queries: DataFrame,
    vectors: DataFrame | None = None,
    compliance: bool = False,
) -> DataFrame:
    """Final hits per query: query_id, rank, doc_id, seq, page_no, content, score, pinned, sources, kind, case_id.

    `queries`: query_id, text, and optionally top_k, query_vec, only_pinned, scope_category, scope_tags.
    `docs`: doc_id, pinned, category, tags. `vectors`: doc_id, seq, vec, or better `vector_rows` made beforehand.
    Without vectors the keyword lists answer alone.
    """
    top_k = F.col("top_k") if "top_k" in queries.columns else F.lit(0)
    queries = with_scope(queries).withColumn("top_k", effective_top_k(F.coalesce(top_k, F.lit(0)), compliance))
    queries = written(queries.withColumn("depth", candidate_depth(F.col("top_k"))), "queries")
    facts = queries.agg(
        F.max("depth").alias("depth"),
        F.max(pinned_budget(F.col("top_k"))).alias("budget"),
        F.coalesce(F.max(restricted()), F.lit(False)).alias("restricted"),
    ).first()
    asking = queries.filter(~blank(F.col("text")))
    scope = Scope(queries, docs, active=facts["restricted"])
    found = keyword_search(index, asking, scope=scope, max_depth=facts["depth"])
    chunks = index.corpus.select("doc_id", "seq", "page_no", "content")
    near = None
    if vectors is not None:
        held = vectors if "content" in vectors.columns else vector_rows(vectors, chunks)
        near = semantic_search(held, asking, scope=scope, max_depth=facts["depth"])
    fused = written(fuse(ranked_lists(found, near)), "fused")
    return final_hits(queries, fused, pinned_rows(chunks, docs, queries, facts["budget"] or 0))
