"""From hits to what a model reads and a user sees: context, quotes, badges, citations, run statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import rounded

# --- fixed values ---
CONTEXT_CHARS = 12_000
BLOCK_GAP = "\n\n"
EMPTY_CONTEXT = "（资料库暂无相关内容）"
CUT_BLOCK = "…（本段已截断）"
CUT_HEAD, CUT_TAIL = "（上下文已达长度上限，后面 ", " 段未纳入本次回答）\n\n"
SNIPPET_CHARS = 160
PINNED_MARK = "（钉住资料）"
ATTACHMENTS_HEAD = "【本次附件文本】\n"
BADGE_FAILED, BADGE_CASE, BADGE_PINNED = "失败案例", "案例", "钉住"
BADGE_BOTH, BADGE_SEMANTIC, BADGE_KEYWORD = "KW+SEM", "语义", "KW"
CITATION = r"\[来源\s*(\d+)\]"
# --- end of fixed values ---


def with_names_and_outcomes(hits: DataFrame, names: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Late lookup of names (documents and cases) and of the outcome of case hits, after the final cut."""
    out = hits.join(names.select("doc_id", "name"), "doc_id", "left").withColumn(
        "doc_name", F.coalesce("name", F.lit(L.DELETED_NAME))
    )
    out = out.drop("name")
    if cases is None:
        return out.withColumn("outcome", F.lit(None).cast("string"))
    return out.join(cases.select("case_id", "outcome"), "case_id", "left")


def source_block() -> Column:
    """`[来源N]` head and content; cases and documents must read differently."""
    number = F.concat(F.lit("[来源"), F.col("rank"), F.lit("] "))
    source = L.mapped(F.col("outcome"), L.CASE_SOURCE, L.CASE_SOURCE["success"])
    case_head = F.concat(F.lit("【"), source, F.lit("】"), L.without_case_prefix(F.col("doc_name")))
    page = F.when(F.coalesce("page_no", F.lit(0)) != 0, F.concat(F.lit("第"), F.col("page_no"), F.lit("页"))).otherwise("")
    mark = F.when(F.col("pinned"), PINNED_MARK).otherwise("")
    doc_head = F.concat(F.lit("《"), F.col("doc_name"), F.lit("》"), page, mark)
    head = F.when(F.col("kind") == "case", case_head).otherwise(doc_head)
    return F.concat(number, head, F.lit("\n"), F.col("content"))


def build_context(hits: DataFrame, queries: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """(query_id, context, n_used, n_cut): blocks in rank order while they fit, and a note on what was cut.

    A first block beyond the budget is cut instead of left out.
    """
    blocks = hits.select("query_id", "rank", source_block().alias("block"))
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("block") + len(BLOCK_GAP)).over(before), F.lit(0))
    fits = used + F.length("block") <= budget
    shown = (
        F.when(fits, F.col("block"))
        .when(F.col("rank") == 1, F.concat(F.substring("block", 1, budget), F.lit(CUT_BLOCK)))
    )
    per_query = (
        blocks.withColumns({"fits": fits, "shown": shown})
        .groupBy("query_id")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("rank", "shown")))).alias("parts"),
            F.count_if(~F.col("fits")).alias("n_cut"),
        )
    )
    text = F.array_join(F.transform("parts", lambda p: p["shown"]), BLOCK_GAP)
    note = F.when(F.col("n_cut") > 0, F.concat(F.lit(CUT_HEAD), F.col("n_cut"), F.lit(CUT_TAIL))).otherwise("")
    return queries.select("query_id").join(per_query, "query_id", "left").select(
        "query_id",
        F.when(F.col("parts").isNull(), EMPTY_CONTEXT).otherwise(F.concat(note, text)).alias("context"),
        F.coalesce(F.size("parts"), F.lit(0)).alias("n_used"),
        F.coalesce("n_cut", F.lit(0)).alias("n_cut"),
    )


def with_attachments(contexts: DataFrame, attachments: DataFrame) -> DataFrame:
    """Append the texts of a question's attachments (query_id, n, name, text) under their names."""
    named = F.concat(F.lit("《"), F.col("name"), F.lit("》\n"), F.col("text"))
    texts = (
        attachments.filter(F.coalesce("text", F.lit("")) != "")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("n", named.alias("text")))).alias("files"))
    )
    tail = F.concat(F.lit(ATTACHMENTS_HEAD), F.array_join(F.transform("files", lambda f: f["text"]), "\n\n"))
    return contexts.join(texts, "query_id", "left").withColumn("context", F.concat_ws("\n\n", "context", tail)).drop("files")


def quotes(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id",
        "rank",
        "doc_id",
        "doc_name",
        "page_no",
        F.substring("content", 1, SNIPPET_CHARS).alias("snippet"),
        rounded(F.col("score"), 2).alias("score"),
        "sources",
        "pinned",
        "kind",
        "case_id",
        F.when(F.col("kind") == "case", F.col("outcome")).alias("outcome"),
    )


def badge() -> Column:
    """What a quote was found by; cases come before all else, failures apart."""
    kw, sem = (F.array_contains("sources", name) for name in ("keyword", "semantic"))
    return (
        F.when((F.col("kind") == "case") & (F.col("outcome") == "fail"), BADGE_FAILED)
        .when(F.col("kind") == "case", BADGE_CASE)
        .when(F.col("pinned"), BADGE_PINNED)
        .when(kw & sem, BADGE_BOTH)
        .when(sem, BADGE_SEMANTIC)
        .when(kw, BADGE_KEYWORD)
        .otherwise("")
    )


def retrieval_stats(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """Per query: chunks searched (`totals`: query_id, n), hits, and how many came by each way."""
    counted = hits.groupBy("query_id").agg(
        F.count("*").alias("hits"),
        F.count_if(F.array_contains("sources", "keyword")).alias("kw"),
        F.count_if(F.array_contains("sources", "semantic")).alias("sem"),
        F.count_if("pinned").alias("pinned"),
        F.count_if(F.col("kind") == "case").alias("cases"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "kw", "sem", "pinned", "cases")]
    return totals.select("query_id", F.col("n").alias("total")).join(counted, "query_id", "left").select(
        "query_id", "total", *zero
    )


def _citation_label(n: Column, name: Column) -> Column:
    return F.coalesce(F.regexp_replace(name, r"(?i)\.[a-z0-9]+\z", ""), F.concat(F.lit("来源"), n))


def _names_of_quotes(quoted: DataFrame) -> DataFrame:
    """(msg_id, n, doc_name), one per number: of repeated numbers the least name."""
    return quoted.groupBy("msg_id", F.col("n").cast("int").alias("n")).agg(F.min("doc_name").alias("doc_name"))


def citations(answers: DataFrame, quoted: DataFrame) -> DataFrame:
    """(msg_id, at, n, label) for each [来源N] in answers (msg_id, text); `quoted` is (msg_id, n, doc_name).

    Answers come from a model: a number of any length is a citation; n is null beyond the integers, and the label shows it.
    """
    found = answers.select(
        "msg_id", F.posexplode(F.regexp_extract_all("text", F.lit(CITATION), F.lit(1))).alias("at", "digits")
    ).withColumn("n", F.expr("try_cast(digits AS int)"))
    return found.join(_names_of_quotes(quoted), ["msg_id", "n"], "left").select(
        "msg_id", "at", "n", _citation_label(F.col("digits"), F.col("doc_name")).alias("label")
    )


def rendered_answers(answers: DataFrame, quoted: DataFrame) -> DataFrame:
    """Answers with each citation replaced by the name of its document. Quotes per answer are few."""
    named = _names_of_quotes(quoted).filter(F.col("n").isNotNull())
    names = named.groupBy("msg_id").agg(F.map_from_entries(F.collect_list(F.struct("n", "doc_name"))).alias("names"))
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s){CITATION}|.+?(?={CITATION}|\z)"), F.lit(0))

    def shown(piece: Column) -> Column:
        n = F.regexp_extract(piece, f"^{CITATION}$", 1)
        name = F.element_at("names", F.try_to_number(n, F.lit("999999999")).cast("int"))
        return F.when(n == "", piece).otherwise(_citation_label(n, name))

    return answers.join(names, "msg_id", "left").select(
        "msg_id", F.array_join(F.transform(pieces, shown), "").alias("text")
    )
