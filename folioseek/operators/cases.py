"""Verified field cases: gate, searchable text, validation, completion, statistics and export."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import blank, null_if_blank, trimmed

# --- fixed values ---
FIX_MAX = 8000
TITLE_MAX = 80
OUTCOMES = ("success", "partial", "fail")
ERROR_FIX_FAILED = "请填写「试过什么、后来怎样」—— 失败记录也有用，它拦住的是一次重复的失败"
ERROR_FIX = "请填写「最终怎么解决的」—— 这是案例最重要的字段"
ERROR_OUTCOME = "请选择结果（成功 / 部分成功 / 失败）"
ERROR_OUTCOME_VALUE = "结果取值不合法"
FIELD_PRODUCT, FIELD_ENVIRONMENT, FIELD_GAP = "产品/型号：", "环境：", "｜"
FIELD_PROBLEM, FIELD_CAUSE, FIELD_OUTCOME = "现象：", "根因：", "结果："
FIELD_NOTES, FIELD_TAGS, FIELD_DATE = "注意：", "标签：", "记录时间："
# --- end of fixed values ---


def _filled(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def _line(label: str | Column, value: Column) -> Column:
    """`label` + `value`, or null when there is no value, so that concat_ws leaves the line out."""
    return F.concat(F.lit(label) if isinstance(label, str) else label, value)


def case_time() -> Column:
    return F.coalesce("occurred_at", "created_at")


def case_date() -> Column:
    return F.date_format(case_time(), "yyyy-MM-dd")


def is_indexable() -> Column:
    """The gate to retrieval: verified and with a fix. Failed attempts count too."""
    return F.coalesce("verified", F.lit(True)) & (F.coalesce("final_fix", F.lit("")) != "")


def case_text() -> Column:
    """A case as searchable text; field names are part of it, and a failure never reads as a solution."""
    product = _line(FIELD_PRODUCT, _filled("product"))
    environment = _line(FIELD_ENVIRONMENT, _filled("environment"))
    setting = F.concat_ws(FIELD_GAP, product, environment)
    outcome = F.col("outcome")
    return F.concat_ws(
        "\n",
        F.concat(
            L.mapped(outcome, L.CASE_HEADER, L.CASE_HEADER_UNKNOWN), F.coalesce(_filled("title"), F.lit(L.UNTITLED))
        ),
        F.when(setting != "", setting),
        _line(FIELD_PROBLEM, _filled("problem")),
        _line(FIELD_CAUSE, _filled("root_cause")),
        F.concat(L.fix_label(outcome), F.lit("："), F.coalesce("final_fix", F.lit(""))),
        _line(FIELD_OUTCOME, L.mapped(outcome, L.OUTCOME_LABEL)),
        _line(FIELD_NOTES, _filled("notes")),
        F.when(F.size("tags") > 0, _line(FIELD_TAGS, F.array_join("tags", " "))),
        _line(FIELD_DATE, case_date()),
    )


def case_corpus(cases: DataFrame) -> DataFrame:
    """Indexable cases as corpus rows under virtual document ids, one row per case."""
    doc_id = F.concat(F.lit(L.CASE_ID_PREFIX), F.col("case_id"))
    return cases.filter(is_indexable()).select(
        doc_id.alias("doc_id"),
        F.lit(0).alias("seq"),
        case_text().alias("content"),
        F.lit(None).cast("int").alias("page_no"),
    )


def case_names(cases: DataFrame) -> DataFrame:
    return cases.filter(is_indexable()).select(
        F.concat(F.lit(L.CASE_ID_PREFIX), F.col("case_id")).alias("doc_id"),
        F.concat(F.lit(L.CASE_NAME_PREFIX), F.coalesce(_filled("title"), F.lit(L.UNTITLED))).alias("name"),
    )


def library_corpus(chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """Document chunks and cases as one corpus."""
    columns = ["doc_id", "seq", "content", "page_no"]
    return chunks.select(*columns).unionByName(case_corpus(cases))


def newest_first(cases: DataFrame) -> DataFrame:
    """By the second of occurrence, else of recording."""
    return cases.orderBy(F.date_trunc("second", case_time()).desc_nulls_last(), "case_id")


def case_stats(cases: DataFrame) -> DataFrame:
    counts = [F.count_if(F.coalesce(F.col("outcome") == o, F.lit(False))).alias(o) for o in OUTCOMES]
    return cases.agg(F.count("*").alias("total"), *counts)


def case_totals(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("total"), F.count_if(F.coalesce("verified", F.lit(True))).alias("verified"))


def tag_counts(rows: DataFrame) -> DataFrame:
    counted = rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), "tag")


def filter_cases(cases: DataFrame, outcome: str = "all", only_unverified: bool = False, text: str = "") -> DataFrame:
    """The case list by outcome, verification and a substring over all its fields."""
    if outcome and outcome != "all":
        cases = cases.filter(F.col("outcome") == outcome)
    if only_unverified:
        cases = cases.filter(~F.coalesce("verified", F.lit(True)))
    needle = (text or "").strip().lower()
    if needle:
        fields = ["title", "problem", "root_cause", "final_fix", "product", "environment", "notes"]
        tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
        hay = F.concat_ws(" ", *(_filled(f) for f in fields), F.when(tags != "", tags))
        cases = cases.filter(F.contains(F.lower(hay), F.lit(needle)))
    return cases


def case_error() -> Column:
    """The first thing wrong with a case, null when it may be saved."""
    outcome = F.col("outcome")
    missing = F.when(outcome == "fail", ERROR_FIX_FAILED).otherwise(ERROR_FIX)
    too_long = F.concat(F.lit("「"), L.fix_label(outcome), F.lit(f"」过长（上限 {FIX_MAX} 字）"))
    return (
        F.when(blank(F.col("final_fix")), missing)
        .when(F.coalesce(outcome, F.lit("")) == "", ERROR_OUTCOME)
        .when(~outcome.isin(*OUTCOMES), ERROR_OUTCOME_VALUE)
        .when(F.length("final_fix") > FIX_MAX, too_long)
    )


def complete_cases(inputs: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Form inputs as whole cases. An edit keeps id, dates and origin of the stored row.

    Fields the form left out (null) fall back to the stored ones where they are not free text.
    """
    if base is not None:
        inputs = inputs.join(base.select("case_id", F.struct("*").alias("old")), "case_id", "left")
        old = lambda c: F.col("old")[c]
    else:
        kinds = {f.name: f.dataType for f in inputs.schema.fields}
        old = lambda c: F.lit(None).cast(kinds[c])
    typed = F.substring(trimmed(F.coalesce(_filled("title"), _filled("problem"), F.lit(""))), 1, TITLE_MAX)
    text = ["problem", "product", "environment", "root_cause", "notes"]
    kept = ["doc_ids", "ai_advice", "occurred_at", "conv_id", "msg_id"]
    return inputs.select(
        "case_id",
        F.coalesce(F.when(typed != "", typed), F.when(old("title") != "", old("title")), F.lit(L.UNTITLED_CASE)).alias(
            "title"
        ),
        *(null_if_blank(F.col(c)).alias(c) for c in text),
        *(F.coalesce(F.col(c), old(c)).alias(c) for c in kept),
        trimmed(F.col("final_fix")).alias("final_fix"),
        "outcome",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.col("verified"), old("verified"), F.lit(True)).alias("verified"),
        F.coalesce(old("created_at"), F.col("created_at")).alias("created_at"),
    )


def case_markdown(cases: DataFrame) -> DataFrame:
    """(place, case_id, markdown): one section per case, numbered newest first, unused ones marked.

    Places come from a range sort: each partition numbers its own rows after the rows before it.
    """
    outcome = F.col("outcome")
    unused = F.when(F.coalesce("verified", F.lit(True)), "").otherwise("（未参与检索）")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("- 结果："), L.mapped(outcome, L.OUTCOME_LABEL), unused),
        _line("- 产品 / 型号：", _filled("product")),
        _line("- 环境：", _filled("environment")),
        _line("- 问题 / 现象：", _filled("problem")),
        _line("- 根因：", _filled("root_cause")),
        F.concat(F.lit("- "), L.fix_label(outcome), F.lit("："), F.coalesce("final_fix", F.lit(""))),
        _line("- 注意：", _filled("notes")),
        F.when(F.size("tags") > 0, _line("- 标签：", F.array_join("tags", "、"))),
        F.concat(F.lit("- 记录时间："), F.coalesce(case_date(), F.lit(""))),
    )
    title = F.coalesce(_filled("title"), F.lit(L.UNTITLED_CASE))
    sections = cases.select("case_id", F.date_trunc("second", case_time()).alias("at"), title.alias("title"), body.alias("body"))
    heading = F.concat(F.lit("## "), F.col("place"), F.lit(". "), F.col("title"))
    return numbered(sections, [F.col("at").desc_nulls_last(), F.col("case_id")], "place").select(
        "place", "case_id", F.concat(heading, F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("markdown")
    )


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A running number over the whole table without a one-task window.

    The rows are range-sorted; partition sizes (one number per partition) give each partition its start.
    """
    from .tables import written

    placed = written(rows.orderBy(*order).withColumns({"_part": F.spark_partition_id()}), "numbered")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", start.alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + inside).cast("int"))
        .drop("_part", "_start")
    )
