"""Which documents a query may see: pinned-only, one category, any of some tags, all at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import is_case
from .tables import written

ANY = "*"
SCOPE_COLUMNS = ("only_pinned", "scope_category", "scope_tags")


def with_scope(queries: DataFrame) -> DataFrame:
    """Fill the optional scope columns; an empty category or tag list restricts nothing."""
    have = set(queries.columns)
    none = F.lit(None)
    return queries.withColumns(
        {
            "only_pinned": F.coalesce("only_pinned", F.lit(False)) if "only_pinned" in have else F.lit(False),
            "scope_category": F.when(F.col("scope_category") != "", F.col("scope_category"))
            if "scope_category" in have
            else none.cast("string"),
            "scope_tags": F.when(F.size("scope_tags") > 0, F.array_distinct("scope_tags"))
            if "scope_tags" in have
            else none.cast("array<string>"),
        }
    )


def restricted() -> Column:
    return F.col("only_pinned") | F.col("scope_category").isNotNull() | F.col("scope_tags").isNotNull()


def _facet_keys(docs: DataFrame) -> DataFrame:
    """Every (pin, category, tag) key a row with facets answers to; ANY stands for an absent condition."""
    pin = F.when(F.coalesce("pinned", F.lit(False)), F.array(F.lit(ANY), F.lit("p"))).otherwise(F.array(F.lit(ANY)))
    category = F.array_compact(F.array(F.lit(ANY), F.concat(F.lit("="), F.col("category"))))
    own = F.transform(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), lambda t: F.concat(F.lit("="), t))
    return (
        docs.withColumn("pin_key", F.explode(pin))
        .withColumn("category_key", F.explode(category))
        .withColumn("tag_key", F.explode(F.concat(F.array(F.lit(ANY)), own)))
    )


def _wanted_keys(queries: DataFrame) -> DataFrame:
    tags = F.transform("scope_tags", lambda t: F.concat(F.lit("="), t))
    return with_scope(queries).filter(restricted()).select(
        "query_id",
        F.when(F.col("only_pinned"), "p").otherwise(ANY).alias("pin_key"),
        F.coalesce(F.concat(F.lit("="), F.col("scope_category")), F.lit(ANY)).alias("category_key"),
        F.explode(F.coalesce(tags, F.array(F.lit(ANY)))).alias("tag_key"),
    )


def signatures(docs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(signature, pinned, category, tags, n): the distinct facets with their documents, or the sum of `counts.n` over them.

    Documents are added up here once; everything after works on signatures, of which there are as many as
    combinations of labels in use.
    """
    own = F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))))
    facets = docs.select("doc_id", F.coalesce("pinned", F.lit(False)).alias("pinned"), "category", own.alias("tags"))
    each = F.lit(1)
    if counts is not None:
        facets, each = facets.join(counts, "doc_id"), F.col("n")
    added = facets.groupBy("pinned", "category", "tags").agg(F.sum(each).alias("n"))
    return added.select(F.to_json(F.struct("pinned", "category", "tags")).alias("signature"), "*")


def resolve_scope(queries: DataFrame, signed: DataFrame) -> DataFrame:
    """(query_id, signature, n) of the signatures that a restricted query sees; a query without rows here sees nothing.

    The three conditions become one equi-join on a facet key. Documents behind a signature are not listed: a
    document's own facets tell whether a query sees it (`Scope`).
    """
    keys = ["pin_key", "category_key", "tag_key"]
    met = _facet_keys(signed).join(_wanted_keys(queries), keys)
    return met.select("query_id", "signature", "n").distinct()


def scoped_counts(queries: DataFrame, docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(query_id, n): sum of `counts.n` per document over each query's scope; all documents if unrestricted."""
    signed = written(signatures(docs, counts), "signatures")
    inside = resolve_scope(queries, signed).groupBy("query_id").agg(F.sum("n").alias("n_inside"))
    total = signed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return (
        with_scope(queries)
        .select("query_id", restricted().alias("narrow"))
        .join(inside, "query_id", "left")
        .select(
            "query_id",
            F.when(F.col("narrow"), F.coalesce("n_inside", F.lit(0))).otherwise(total.scalar()).cast("long").alias("n"),
        )
    )


class Scope:
    """Filters (query_id, doc_id) rows by looking attributes up, without listing query-document pairs."""

    def __init__(self, queries: DataFrame, docs: DataFrame, active: bool | None = None):
        scoped = with_scope(queries)
        self.active = not scoped.filter(restricted()).isEmpty() if active is None else active
        self.queries = scoped.select("query_id", *SCOPE_COLUMNS)
        self.docs = docs.select("doc_id", "pinned", "category", "tags")

    def attach(self, rows: DataFrame) -> DataFrame:
        """Rows with the pinned, category and tags of their document."""
        return rows.join(self.docs, "doc_id", "left")

    def keep(self, rows: DataFrame, cases: bool = True) -> DataFrame:
        """Rows whose document the query may see. Keyword recall passes cases whatever the scope."""
        if not self.active:
            return rows
        fits = (
            (~F.col("only_pinned") | F.coalesce("pinned", F.lit(False)))
            & (F.col("scope_category").isNull() | F.coalesce(F.col("category") == F.col("scope_category"), F.lit(False)))
            & (F.col("scope_tags").isNull() | F.coalesce(F.arrays_overlap("tags", "scope_tags"), F.lit(False)))
        )
        visible = ~restricted() | fits
        if cases:
            visible = visible | is_case(F.col("doc_id"))
        return rows.join(self.queries, "query_id").join(self.docs, "doc_id", "left").filter(visible).select(*rows.columns)
