"""One entry per operator of the inventory: name -> function (spark, sf_dir) -> DataFrame.

Every entry reads whole given tables. Arrays are joined to text and scores rounded, so that results
can be compared with SQL by value.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import tables as t
from folioseek.functions import labels as L
from folioseek.functions import net, quality, text
from folioseek.functions.classify import classify, pick_kind, pick_model
from folioseek.operators import access, conversations, library, spans
from folioseek.operators import cases as cs
from folioseek.operators import compliance as cp
from folioseek.operators import context as cx
from folioseek.operators.chunk import chunk_documents
from folioseek.operators.fuse import (
    candidate_depth,
    effective_top_k,
    fuse,
    pinned_budget,
    pinned_rows,
    ranked_lists,
)
from folioseek.operators.index import corpus_fingerprint, idf, occurrences, token_counts
from folioseek.operators.keyed import create_table, delete_from_table, read_table, upsert_table
from folioseek.operators.keyword import keyword_search, query_terms
from folioseek.operators.scope import Scope, resolve_scope, scoped_counts, signatures
from folioseek.operators.semantic import cosine, embed_corpus, embedding_coverage, embedding_stats, semantic_search, vector_rows
from folioseek.operators.tables import delete_cascade, first_seen, scratch_dir, scratch_path, upsert, with_name, written
from folioseek.plans.ingest import first_copies, import_files, sync_files
from folioseek.plans.retrieve import hybrid_retrieve
from folioseek.session import ensure_scratch
from folioseek.sources.files import file_type, routed
from folioseek.streaming.sync import sync_stream, synced

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_scratch(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        return f

    return add


def r6(c: Column | str) -> Column:
    return text.rounded(F.col(c) if isinstance(c, str) else c, 6)


def joined(c: Column | str, sep: str = " ") -> Column:
    return F.array_join(c, sep)


# ---- sources and sinks


@query("S1_file_types")
def _(spark, d):
    return t.files(spark, d).select("name", "size", file_type(F.col("name")).alias("type"))


def decode_extractor():
    """Stands in for a PDF/DOCX parser: these files hold plain UTF-8, one page per 3000 characters."""

    def extract(content: bytes, name: str):
        body = content.decode("utf-8")
        return body, (len(body) // 3000 + 1 if name.endswith(".pdf") else None), None

    return extract


def parsed_files(spark, d, **options):
    return routed(t.files(spark, d), decode_extractor, **options)


@query("S2_route_files")
def _(spark, d):
    out = parsed_files(spark, d)
    return out.select("name", "type", "source", r6("quality").alias("quality"), "pages", "note", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


@query("S3_import")
def _(spark, d):
    docs = import_files(parsed_files(spark, d), None, [F.col("number")], "inbox").documents
    return docs.select("doc_id", "name", "type", "status", "model", "kind", "category", r6("parse_quality").alias("parse_quality"), "chars")


@query("S4_folder_sync")
def _(spark, d):
    known = t.documents(spark, d).filter(F.col("category") == "reviewed").select("doc_id", "hash")
    done = sync_files(parsed_files(spark, d), known, [F.col("number")])
    return done.counts


@query("S5_corpus_scan")
def _(spark, d):
    names = t.light_documents(spark, d).select("doc_id", "name")
    return t.chunks(spark, d).join(names, "doc_id").select("doc_id", "seq", "name", "content")


@query("S6_upsert")
def _(spark, d):
    base = t.light_documents(spark, d).select("doc_id", "name", "category")
    edits = t.cases(spark, d).select(F.col("case_id").alias("doc_id"), F.col("outcome").alias("name"), F.col("environment").alias("category"))
    return upsert(base, edits, ["doc_id"])


@query("S7_delete_document")
def _(spark, d):
    docs = t.light_documents(spark, d)
    left = delete_cascade(
        docs.filter("pinned"), {"documents": docs.select("doc_id"), "chunks": t.chunks(spark, d), "vectors": t.vectors(spark, d)}, "doc_id"
    )
    counted = [rows.agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, rows in left.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("S6_merge_on_disk")
def _(spark, d):
    """The upsert as a new version of a table in buckets."""
    path = scratch_path(spark, "keyed")
    base = t.light_documents(spark, d).select("doc_id", "name", "category")
    edits = t.cases(spark, d).select(F.col("case_id").alias("doc_id"), F.col("outcome").alias("name"), F.col("environment").alias("category"))
    create_table(base, path, ["doc_id"], 16)
    upsert_table(path, edits, ["doc_id"])
    return read_table(spark, path)


@query("S7_delete_on_disk")
def _(spark, d):
    """Pinned documents leave a table of chunks dealt by document."""
    path = scratch_path(spark, "keyed")
    create_table(t.chunks(spark, d).select("doc_id", "seq", "content"), path, ["doc_id"], 16)
    delete_from_table(path, t.light_documents(spark, d).filter("pinned").select("doc_id"), "doc_id")
    return read_table(spark, path).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query("S8_compliance_csv")
def _(spark, d):
    return cp.compliance_export(cp.parse_replies(t.replies(spark, d)), "csv")


@query("S9_compliance_markdown")
def _(spark, d):
    return cp.compliance_export(cp.parse_replies(t.replies(spark, d)), "markdown")


@query("S10_conversation_markdown")
def _(spark, d):
    quoted = t.quoted_documents(spark, d).withColumn("snippet", F.substring("text", 1, cx.SNIPPET_CHARS))
    return conversations.conversation_markdown(t.turns(spark, d), quoted)


@query("S11_cases_markdown")
def _(spark, d):
    return cs.case_markdown(t.cases(spark, d))


# ---- projections, filters, predicates


@query("F1_classify")
def _(spark, d):
    raw = t.raw_documents(spark, d)
    model, kind = classify(F.col("name"), F.col("text"))
    return raw.select("doc_id", model.alias("model"), kind.alias("kind"))


@query("F2_pick_model")
def _(spark, d):
    """Capitals of each text next to its number: several candidates, blocked ones among them."""
    raw = t.raw_documents(spark, d)
    codes = F.concat_ws(" ", F.upper("lang"), "doc_id", F.upper("source"), F.lit("QX-"), F.concat(F.lit("QX-"), "doc_id"), F.concat(F.lit("QX"), "doc_id"))
    return raw.select("doc_id", pick_model(F.concat_ws("\n", codes, F.upper("text"))).alias("model"), pick_model(F.col("name"), 1).alias("name_model"))


@query("F3_pick_kind")
def _(spark, d):
    return t.raw_documents(spark, d).select("doc_id", pick_kind(F.col("name"), F.col("text")).alias("kind"))


@query("F4_reclassify")
def _(spark, d):
    stored = t.raw_documents(spark, d).select("doc_id", "name", F.col("category").alias("model"), F.when(F.col("pinned"), "other").alias("kind"))
    labels = written(library.chunk_labels(t.chunks(spark, d)), "labels")
    again = library.reclassified(stored, None, labels=labels)
    filled = library.reclassified(stored, None, fill_only=True, labels=labels)
    return again.join(filled.select("doc_id", F.col("model").alias("model_filled"), F.col("kind").alias("kind_filled")), "doc_id").drop("name")


@query("F5_resolve_scope")
def _(spark, d):
    seen = resolve_scope(t.scoped_queries(spark, d), signatures(t.light_documents(spark, d)))
    return seen.groupBy("query_id").agg(F.count("*").alias("signatures"), F.sum("n").alias("documents"))


@query("F6_library_filter")
def _(spark, d):
    docs = t.documents(spark, d).select("doc_id", "name", "pinned", "tags", "model", "created_at")
    return library.visible_documents(docs, label="fr").select("doc_id", "name", "pinned", t.stamp("created_at").alias("created_at"))


@query("F7_case_gate")
def _(spark, d):
    return t.cases(spark, d).filter(cs.is_indexable()).select("case_id", "outcome")


@query("F8_case_list")
def _(spark, d):
    return cs.filter_cases(t.cases(spark, d), outcome="fail", text="THE").select("case_id", "title")


@query("F9_case_validation")
def _(spark, d):
    return t.cases(spark, d).select("case_id", cs.case_error().alias("error"))


@query("F10_complete_case")
def _(spark, d):
    base = t.cases(spark, d)
    edits = base.withColumns({"title": F.lit(""), "verified": F.lit(None).cast("boolean"), "notes": F.lit("  ")})
    done = cs.complete_cases(edits, base.withColumn("created_at", F.col("created_at") - F.expr("INTERVAL 1 DAY")))
    return done.select("case_id", "title", "problem", "notes", "verified", t.stamp("created_at").alias("created_at"))


@query("F11_bulk_edits")
def _(spark, d):
    docs = t.light_documents(spark, d)
    drafts = docs.filter(F.col("category") == "draft")
    edited = library.set_category(library.set_pinned(docs, drafts, True), drafts, " ")
    edited = library.add_tags(edited, drafts, ["en", " new ", ""])
    edited = library.replace_tags(edited, docs.filter(F.col("pinned")), ["kept", "kept"])
    return edited.select("doc_id", "pinned", "category", joined("tags", ",").alias("tags"))


@query("F12_rename_category")
def _(spark, d):
    docs = library.rename_category(t.light_documents(spark, d), "draft", "attic")
    listed = spark.createDataFrame([("reviewed",)], "category string")
    stale = library.stale_categories(docs, listed).groupBy("category").agg(F.count("*").alias("n"))
    return library.category_counts(docs).join(stale.withColumnRenamed("n", "stale"), "category", "left")


@query("F13_service_quality")
def _(spark, d):
    pages = F.ceil(F.length("text") / 900).cast("int")
    return t.texts(spark, d).select("doc_id", r6(quality.service_quality(F.col("text"), pages)).alias("quality"))


@query("F14_local_quality")
def _(spark, d):
    pages = F.ceil(F.length("text") / 150).cast("int")
    paged, flow = quality.paged_quality(F.col("text"), pages), quality.flow_quality(F.col("text"))
    return t.texts(spark, d).select(
        "doc_id", r6(paged["quality"]).alias("quality"), paged["has_text"].alias("has_text"), paged["note"].alias("note"), r6(flow["quality"]).alias("flow_quality")
    )


@query("F15_url_class")
def _(spark, d):
    return t.given(spark, d, "pages").select("page_id", net.url_host(F.col("url")).alias("host"), net.is_private_host(F.col("url")).alias("private"))


# ---- joins


@query("J1_chunks_of_pinned")
def _(spark, d):
    pinned = t.light_documents(spark, d).filter("pinned").select("doc_id", "name")
    return t.chunks(spark, d).join(pinned, "doc_id").groupBy("name").agg(F.count("*").alias("n"), F.sum(F.length("content") + 1).alias("chars"))


@query("J2_name_lookup")
def _(spark, d):
    names = t.light_documents(spark, d)
    return with_name(t.vectors(spark, d).select("doc_id", "label"), names.filter("not pinned"), "doc_id", "name", L.DELETED_NAME)


@query("J3_restrict_ids")
def _(spark, d):
    ids = t.light_documents(spark, d).filter("pinned")
    return t.chunks(spark, d).join(ids, "doc_id", "left_semi").select("doc_id", "seq", "content")


@query("J4_known_hashes")
def _(spark, d):
    docs = t.documents(spark, d).select("doc_id", "hash", "category")
    known = docs.filter("category = 'reviewed'")
    new = docs.filter("category is null")
    return new.join(known.select("hash"), "hash", "left_anti").select("doc_id")


@query("J5_query_postings")
def _(spark, d):
    ix = t.index(spark, d, with_cases=False)
    terms = written(query_terms(ix, t.queries(spark, d)), "terms")
    found = occurrences(ix).join(terms, "term").groupBy("query_id", "term")
    return found.agg(F.count("*").alias("chunks"), F.sum("tf").alias("uses"), F.max("tf").alias("most"))


@query("J6_same_size_vectors")
def _(spark, d):
    """Vectors and query vectors of two sizes: every third number has half a vector."""
    short = lambda c, n: F.when(F.col(n) % 3 == 0, F.slice(c, 1, 32)).otherwise(F.col(c))
    q = t.vector_queries(spark, d).withColumn("query_vec", short("query_vec", "query_id"))
    v = t.vectors(spark, d).withColumn("number", F.col("doc_id").cast("long")).withColumn("vec", short("vec", "number"))
    keys = v.select("doc_id", "seq", F.lit(None).cast("int").alias("page_no"), F.lit("").alias("content"))
    hits = semantic_search(vector_rows(v, keys), q, 5)
    return hits.select("query_id", "rank", "doc_id", r6("score").alias("score"))


@query("J7_vectors_with_chunk")
def _(spark, d):
    found = t.vectors(spark, d).select("doc_id", "seq", "label").join(t.chunks(spark, d), ["doc_id", "seq"])
    return found.select("doc_id", "seq", "label", F.length("content").alias("chars"))


@query("J8_case_outcomes")
def _(spark, d):
    hits = keyword_search(t.index(spark, d), t.queries(spark, d), 20).select("query_id", "rank", "doc_id")
    hits = hits.withColumn("case_id", L.case_id_of(F.col("doc_id")))
    return hits.join(t.cases(spark, d).select("case_id", "outcome"), "case_id", "left").select("query_id", "rank", "doc_id", "outcome")


@query("J9_delete_users")
def _(spark, d):
    people, held = t.users(spark, d), t.credentials(spark, d)
    left, owned = access.delete_users(people.filter("disabled"), people, held)
    return owned.groupBy("kind").agg(F.count("*").alias("n")).withColumn("users", left.agg(F.count("*").alias("u")).scalar())


@query("J10_citation_quotes")
def _(spark, d):
    answers = t.cited_answers(spark, d)
    cited = cx.citations(answers, t.quoted_documents(spark, d))
    return cited.select("msg_id", "at", "n", "label")


# ---- aggregations


@query("A1_index_terms")
def _(spark, d):
    ix = t.index(spark, d)
    tf = occurrences(ix).groupBy("term").agg(F.sum("tf").alias("uses"))
    return ix.terms.join(tf, "term").select("term", "df", "uses", r6(idf(F.col("df"), ix.n)).alias("idf"))


@query("A1_index_size")
def _(spark, d):
    ix = t.index(spark, d)
    return ix.corpus.agg(F.count("*").alias("n"), r6(F.avg("dl")).alias("avgdl"), F.sum("dl").alias("tokens"))


@query("A2_case_outcomes")
def _(spark, d):
    return cs.case_stats(t.cases(spark, d))


@query("A3_case_tags")
def _(spark, d):
    return cs.tag_counts(t.cases(spark, d))


@query("A4_case_totals")
def _(spark, d):
    return cs.case_totals(t.cases(spark, d))


def chunk_counts(spark, d):
    return t.chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("A5_chunks_in_scope")
def _(spark, d):
    return scoped_counts(t.scoped_queries(spark, d), t.light_documents(spark, d), chunk_counts(spark, d))


@query("A6_fingerprint")
def _(spark, d):
    return corpus_fingerprint(cs.library_corpus(t.chunks(spark, d), t.cases(spark, d)))


@query("A7_embedding_stats")
def _(spark, d):
    return embedding_stats(t.vectors(spark, d))


@query("A7_embedding_coverage")
def _(spark, d):
    return embedding_coverage(t.vectors(spark, d), t.chunks(spark, d))


@query("A9_category_counts")
def _(spark, d):
    return library.category_counts(t.light_documents(spark, d))


@query("A9_unclassified")
def _(spark, d):
    return library.unclassified_counts(t.documents(spark, d))


@query("A10_by_model")
def _(spark, d):
    return library.grouped(t.documents(spark, d), "model")


@query("A10_by_kind")
def _(spark, d):
    return library.grouped(t.documents(spark, d), "kind")


@query("A10_by_category")
def _(spark, d):
    return library.grouped(t.light_documents(spark, d), "category")


@query("A10_by_tag")
def _(spark, d):
    return library.grouped(t.light_documents(spark, d), "tag")


@query("A11_tags")
def _(spark, d):
    return library.all_tags(t.light_documents(spark, d))


@query("A11_tags_and_models")
def _(spark, d):
    return library.label_options(t.documents(spark, d))


@query("A12_credentials_per_user")
def _(spark, d):
    return access.users_with_counts(t.users(spark, d), t.credentials(spark, d)).select("id", "username", "role", "disabled", "tokens", "api_keys")


@query("A13_store_counts")
def _(spark, d):
    return access.store_counts(t.users(spark, d), t.credentials(spark, d))


@query("A13_other_admins")
def _(spark, d):
    return access.other_admins(t.users(spark, d), 0)


@query("A14_verdicts")
def _(spark, d):
    return cp.verdict_counts(cp.parse_replies(t.replies(spark, d)))


# ---- windows


@query("W1_rank_in_lists")
def _(spark, d):
    lists = ranked_lists(keyword_search(t.index(spark, d), t.queries(spark, d), 20))
    return lists.select("query_id", "list", "rank", "doc_id", "seq")


@query("W2_chunks")
def _(spark, d):
    return t.chunks(spark, d).select("doc_id", "seq", "content", "ctype")


@query("W4_first_copies")
def _(spark, d):
    docs = t.documents(spark, d).select("doc_id", "hash", "name", "created_at")
    return first_seen(docs, ["hash"], [F.col("created_at"), F.col("doc_id")]).select("doc_id", "name")


@query("W5_nearest_question")
def _(spark, d):
    return conversations.answered_questions(t.turns(spark, d))


@query("W8_span_rows")
def _(spark, d):
    rows = spans.span_rows(t.spans(spark, d))
    return rows.groupBy("doc_id", "page", "band", "row").agg(F.count("*").alias("n"), F.min("mid").alias("top")).groupBy("doc_id", "page").agg(
        F.count("*").alias("rows"), F.max("n").alias("widest"), F.sum("top").alias("tops")
    )


# ---- top k, sorts


@query("T1_bm25_top")
def _(spark, d):
    hits = keyword_search(t.index(spark, d, with_cases=False), t.queries(spark, d), 3)
    return hits.select("query_id", "rank", "doc_id", "seq", r6("raw").alias("raw"))


@query("T2_depth")
def _(spark, d):
    asked = t.queries(spark, d).withColumn("top_k", effective_top_k(F.length("text") / 20))
    return asked.select("query_id", "top_k", candidate_depth(F.col("top_k")).alias("depth"), pinned_budget(F.col("top_k")).alias("pinned"))


@query("T3_pinned_chunks")
def _(spark, d):
    asked = t.queries(spark, d).withColumn("top_k", effective_top_k(F.length("text") / 20))
    return pinned_rows(t.chunks(spark, d), t.light_documents(spark, d), asked).select("query_id", "place", "doc_id", "seq")


@query("T5_cases_by_time")
def _(spark, d):
    return cs.newest_first(t.cases(spark, d)).select("case_id", t.stamp(cs.case_time()).alias("at"))


@query("T6_newest_conversations")
def _(spark, d):
    convs = t.turns(spark, d).groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return conversations.newest_conversations(convs, [F.col("conv_id").desc()])


@query("T6_newest_per_owner")
def _(spark, d):
    convs = t.turns(spark, d).groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return conversations.newest_conversations(convs, [F.col("conv_id").desc()], owner="last_turn")


@query("T8_newest_documents")
def _(spark, d):
    return library.newest(t.light_documents(spark, d)).select("doc_id", "name", t.stamp("created_at").alias("created_at"))


# ---- set operations


@query("X1_corpus")
def _(spark, d):
    rows = cs.library_corpus(t.chunks(spark, d), t.cases(spark, d))
    return rows.select("doc_id", "seq", "content")


@query("X2_list_union")
def _(spark, d):
    lists = hit_lists(spark, d)
    return lists.groupBy("query_id", "list").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.first("weight").alias("weight"))


@query("X3_tag_union")
def _(spark, d):
    return t.light_documents(spark, d).select("doc_id", joined(F.array_union("tags", F.array(F.lit("en"), F.lit("all"))), ",").alias("tags"))


@query("X5_unseen_rows")
def _(spark, d):
    docs = t.documents(spark, d).select("doc_id", "hash", "created_at")
    marked = first_copies(docs, None, [F.col("created_at")])
    return marked.select("doc_id", "is_new")


# ---- retrieval


@query("R1_tokens")
def _(spark, d):
    rows = cs.library_corpus(t.chunks(spark, d), t.cases(spark, d))
    return token_counts(rows)


@query("R1_query_tokens")
def _(spark, d):
    rows = t.queries(spark, d).unionByName(cs.case_corpus(t.cases(spark, d)).select(F.col("doc_id").alias("k"), F.col("content").alias("text")).select(F.regexp_extract("k", r"(\d+)", 1).cast("bigint").alias("query_id"), "text"))
    return rows.select("query_id", joined(text.query_tokens(F.col("text"))).alias("tokens"))


@query("R2_flatten")
def _(spark, d):
    return t.texts(spark, d).select("doc_id", F.md5(text.flat(F.col("text"))).alias("flat"))


@query("R3_idf")
def _(spark, d):
    ix = t.index(spark, d, with_cases=False)
    return query_terms(ix, t.queries(spark, d)).select("query_id", "term", "df", r6("idf").alias("idf"))


@query("R4_phrase_boost")
def _(spark, d):
    """Whole passages as queries: those that a document quotes are found word for word."""
    hits = keyword_search(t.index(spark, d, with_cases=False), t.queries(spark, d), 5)
    return hits.select("query_id", "rank", "doc_id", "seq", r6("raw").alias("raw"))


@query("R6_keyword_search")
def _(spark, d):
    ix, docs, asked = t.index(spark, d), t.light_documents(spark, d), t.scoped_queries(spark, d)
    hits = keyword_search(ix, asked, 10, Scope(asked, docs))
    names = docs.select("doc_id", "name").unionByName(cs.case_names(t.cases(spark, d)))
    named = with_name(hits, names, "doc_id", "name", L.DELETED_NAME)
    return named.select("query_id", "rank", "doc_id", "seq", "name", "score", joined("matched").alias("matched"))


@query("R7_cosine")
def _(spark, d):
    """Each vector against the mean vector of its label."""
    v = t.vectors(spark, d)
    parts = v.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("mean"))
    return v.join(means, "label").select("doc_id", "label", r6(cosine(F.col("vec"), F.col("mean"))).alias("score"))


@query("R8_semantic_search")
def _(spark, d):
    ix, docs, asked = t.index(spark, d), t.light_documents(spark, d), t.scoped_queries(spark, d)
    hits = semantic_search(vector_rows(t.vectors(spark, d), ix.corpus), asked, 10, Scope(asked, docs))
    return hits.select("query_id", "rank", "doc_id", "seq", r6("score").alias("score"))


def hit_lists(spark, d):
    ix, asked = t.index(spark, d), t.vector_queries(spark, d)
    return ranked_lists(keyword_search(ix, asked, 24), semantic_search(vector_rows(t.vectors(spark, d), ix.corpus), asked, 24))


@query("R9_rrf")
def _(spark, d):
    return fuse(hit_lists(spark, d)).select(
        "query_id", "place", "doc_id", "seq", r6("rrf").alias("rrf"), "score", joined("sources", "+").alias("sources")
    )


@query("W6_share_of_best")
def _(spark, d):
    return fuse(hit_lists(spark, d)).groupBy("query_id").agg(F.max("score").alias("best"), F.min("score").alias("least"), F.count("*").alias("n"))


def hybrid(spark, d, **options):
    """Final hits with names and outcomes: the whole pipeline."""
    docs, cases = t.light_documents(spark, d), t.cases(spark, d)
    hits = hybrid_retrieve(t.index(spark, d), docs, t.scoped_queries(spark, d), t.vectors(spark, d), **options)
    names = docs.select("doc_id", "name").unionByName(cs.case_names(cases))
    return written(cx.with_names_and_outcomes(hits, names, cases), "hits")


def shown_hits(hits):
    return hits.select(
        "query_id", "rank", "doc_id", "doc_name", "seq", "score", "pinned", joined("sources", "+").alias("sources"), "kind", "case_id", "outcome"
    )


@query("R10_hybrid")
def _(spark, d):
    return shown_hits(hybrid(spark, d))


@query("T4_compliance_hits")
def _(spark, d):
    return shown_hits(hybrid(spark, d, compliance=True))


@query("R11_name_search")
def _(spark, d):
    asked = t.queries(spark, d).withColumn("text", F.concat_ws(" ", F.concat(F.lit("src"), "query_id"), F.lit("FR"), F.lit("pdf"), F.concat(F.lit("de-"), F.col("query_id")), "text"))
    hits = library.name_search(t.light_documents(spark, d), asked)
    return hits.select("query_id", "rank", "doc_id", r6("score").alias("score"))


@query("R12_search_all")
def _(spark, d):
    docs = t.light_documents(spark, d)
    names = docs.select("doc_id", "name").unionByName(cs.case_names(t.cases(spark, d)))
    asked = t.queries(spark, d).withColumn("text", F.concat_ws(" ", F.lit("src1"), F.lit("en"), "text"))
    found = library.search_all(docs, names, asked, keyword_search(t.index(spark, d), asked, 30))
    return found.select("query_id", "rank", "kind", "doc_id", "doc_name", F.md5("snippet").alias("snippet"), r6("score").alias("score"))


@query("R13_case_text")
def _(spark, d):
    return t.cases(spark, d).select("case_id", cs.case_text().alias("content"))


@query("R14_context")
def _(spark, d):
    contexts = cx.build_context(hybrid(spark, d), t.queries(spark, d))
    files = t.raw_documents(spark, d).filter("pinned").select(F.col("number").alias("query_id"), F.lit(1).alias("n"), "name", "text")
    return cx.with_attachments(contexts, files)


@query("W3_context_budget")
def _(spark, d):
    """Every case as a hit of the query of its language: contexts far beyond the budget."""
    cases = t.cases(spark, d)
    hits = cases.select(
        F.col("environment").alias("query_id"),
        F.row_number().over(cs.Window.partitionBy("environment").orderBy(F.length("final_fix"), "case_id")).alias("rank"),
        F.lit("doc").alias("kind"),
        F.lit(None).cast("string").alias("outcome"),
        F.col("title").alias("doc_name"),
        F.lit(None).cast("int").alias("page_no"),
        F.lit(False).alias("pinned"),
        F.col("final_fix").alias("content"),
    )
    built = cx.build_context(hits, cases.select(F.col("environment").alias("query_id")).distinct())
    return built.select("query_id", "n_used", "n_cut", F.md5("context").alias("context"))


@query("R15_quotes")
def _(spark, d):
    return cx.quotes(hybrid(spark, d)).select("query_id", "rank", "doc_id", "doc_name", "snippet", "score", "kind", "outcome")


@query("R16_badges")
def _(spark, d):
    return hybrid(spark, d).select("query_id", "rank", cx.badge().alias("badge"))


@query("A8_retrieval_stats")
def _(spark, d):
    asked, docs = t.scoped_queries(spark, d), t.light_documents(spark, d)
    return cx.retrieval_stats(hybrid(spark, d), scoped_counts(asked, docs, chunk_counts(spark, d)))


@query("R17_citations")
def _(spark, d):
    return cx.rendered_answers(t.cited_answers(spark, d), t.quoted_documents(spark, d))


def hashing_embedder():
    """Deterministic 16-dimensional vectors for tests: counts of characters by code."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[float(sum(ord(ch) % 16 == i for ch in s)) for i in range(16)] for s in texts]

    return embed


@query("R18_embed_corpus")
def _(spark, d):
    made = embed_corpus(t.chunks(spark, d), hashing_embedder, "hashing")
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return made.select("doc_id", "seq", "model", "dim", F.element_at("vec", 1).cast("double").alias("first"), total.alias("total"))


# ---- scalar functions


@query("N1_compat_fold")
def _(spark, d):
    """Two radicals planted in each text come back as ordinary characters."""
    planted = F.concat(F.lit("⽤⼯，"), "text", F.lit("（隆）"))
    return t.texts(spark, d).select("doc_id", text.compat_folded(planted).alias("text"))


@query("N2_content_hash")
def _(spark, d):
    return t.texts(spark, d).select("doc_id", text.fingerprint(F.col("text")).alias("hash"))


@query("N3_split_tags")
def _(spark, d):
    typed = F.concat("source", F.lit("、"), "lang", F.lit(" ,，"), "source", F.lit(" new tag"))
    raw = t.raw_documents(spark, d)
    return raw.select("doc_id", joined(text.split_tags(typed), "|").alias("tags"), joined(text.split_tags(typed, on_space=False), "|").alias("tags_inner"))


@query("N4_paragraphs")
def _(spark, d):
    wrapped = F.regexp_replace("text", r"\. ", ".\n\n ")
    return t.texts(spark, d).select("doc_id", text.rejoined_paragraphs(wrapped).alias("text"))


@query("N5_titles")
def _(spark, d):
    return conversations.titles(t.turns(spark, d))


@query("N6_drafts")
def _(spark, d):
    drafts = conversations.case_drafts(conversations.answered_questions(t.turns(spark, d)), t.quoted_documents(spark, d))
    return drafts.select("conv_id", "turn", "title", "problem", "ai_advice", joined("doc_ids", ",").alias("doc_ids"))


@query("N7_meta_line")
def _(spark, d):
    return t.documents(spark, d).select("doc_id", text.size_text(F.col("size")).alias("size"), library.meta_line().alias("line"))


@query("N8_span_lines")
def _(spark, d):
    lines = spans.span_lines(t.spans(spark, d))
    return spans.document_texts(lines)


@query("N9_parse_reply")
def _(spark, d):
    return cp.item_rows(cp.parse_replies(t.replies(spark, d)))


@query("N10_prompt")
def _(spark, d):
    """Compliance hits as context, the passage as requirement."""
    asked = t.queries(spark, d)
    contexts = cx.build_context(hybrid(spark, d, compliance=True), asked)
    return asked.join(contexts, "query_id").select("query_id", cp.compliance_prompt(F.col("text"), F.col("context")).alias("prompt"))


@query("N11_chat_history")
def _(spark, d):
    return conversations.chat_history(t.turns(spark, d))


@query("L1_case_labels")
def _(spark, d):
    outcome = F.col("outcome")
    return t.cases(spark, d).select(
        "case_id",
        L.mapped(outcome, L.CASE_HEADER, L.CASE_HEADER_UNKNOWN).alias("header"),
        L.mapped(outcome, L.CASE_SOURCE).alias("source"),
        L.fix_label(outcome).alias("fix"),
        L.mapped(outcome, L.OUTCOME_VERDICT).alias("verdict"),
    )


@query("D0_expiry")
def _(spark, d):
    held = t.credentials(spark, d)
    days = F.when(F.col("kind") == "api", 30).otherwise(0)
    return held.select("id", t.stamp(access.expiry(days, F.col("created_at"))).alias("ends"))


# ---- security table


@query("C1_credential_status")
def _(spark, d):
    """A token per order and per customer: half of the latter are unknown, some are missing."""
    held, people = t.credentials(spark, d), t.users(spark, d)
    own = t.given(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("request_id"), F.concat(F.lit("secret-"), "o_orderkey").alias("token"))
    odd = people.select(F.concat(F.lit("c"), "id").alias("request_id"), F.when(~F.col("disabled"), F.concat(F.lit("guess-"), "id")).alias("token"))
    now = F.to_timestamp(F.lit("2000-01-01"))
    return access.credential_status(own.unionByName(odd), held, people, now).select("request_id", "status", "user_id")


@query("C2_credential_list")
def _(spark, d):
    rows = access.visible_credentials(t.credentials(spark, d), t.users(spark, d).filter("not disabled"), "api", None, True)
    return rows.select("id", "user_id", "username", "prefix", "revoked", t.stamp("expires_at").alias("expires_at"))


# ---- incremental ingestion


@query("D1_dedupe")
def _(spark, d):
    docs = t.documents(spark, d).select("doc_id", "hash", "category", "created_at")
    known = docs.filter("category = 'reviewed'").select("doc_id", "hash")
    marked = first_copies(docs.filter("category is null"), known, [F.col("created_at")])
    return marked.select("doc_id", "is_new")


@query("D2_repeated_sync")
def _(spark, d):
    """English and other documents as two streams of files into one table, each with a checkpoint, then both again with new ones."""
    table = f"{scratch_dir(spark)}/folioseek/synced-{uuid.uuid4().hex}"
    schema = t.given(spark, d, "documents").schema
    # A pattern, as a stream takes a plain path for a folder: the table may be one file or a folder of files.
    stream = spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/documents.parque[t]")
    name = F.concat(F.lit("/"), "source", F.lit("-"), F.col("doc_id"), F.lit(".txt"))
    files = stream.select(
        name.alias("path"),
        t.minutes(F.col("doc_id")).alias("modificationTime"),
        F.octet_length("text").cast("long").alias("length"),
        F.encode("text", "UTF-8").alias("content"),
        "lang",
    )
    parts = (files.filter("lang = 'en'").drop("lang"), files.filter("not lang <=> 'en'").drop("lang"))
    rows = {}
    for run in ("first", "second"):
        for n, part in enumerate(parts):
            sync_stream(part, table, f"{table}/marks-of-{run}-{n}").awaitTermination()
        rows[run] = spark.read.parquet(f"{table}/documents").count()
    docs, chunks = synced(spark, table, "documents"), synced(spark, table, "chunks")
    counts = docs.agg(F.count("*").alias("documents"), F.count_distinct("hash").alias("contents"))
    return counts.withColumns(
        {"chunks": chunks.agg(F.count("*").alias("n")).scalar(), "added_again": F.lit(rows["second"] - rows["first"]).cast("long")}
    )
