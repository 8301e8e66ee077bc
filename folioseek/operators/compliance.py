"""Compliance checks: prompt, reply parsing, verdict counts, CSV and Markdown export."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NO_DATA_PATTERN, verdict_label
from ..functions.text import trimmed

# --- fixed values ---
UNKNOWN_MODEL = "未知"
CSV_HEAD = "项目,要求,实际,判定,来源"
MARKDOWN_HEAD = "| 项目 | 要求 | 实际 | 判定 | 来源 |\n| --- | --- | --- | --- | --- |"
REPLY = (
    "struct<model:string,items:array<struct<item:string,required:string,actual:string,"
    "verdict:string,source:string>>,conclusion:string>"
)
PROMPT_OPEN = """你是一名严谨的树脂材料选型工程师。
下面是用户给出的「技术要求 / 工况要求」，以及资料库中可能相关的树脂 TDS 片段。
请从中找出最匹配的一款树脂体系，并逐项核对要求，给出三态判定。

判定规则：
- verdict 只能是 "ok"（满足）/ "no"（不满足或超标）/ "warn"（差一点 / 临界 / 资料不足）
- 每项给出 required（要求值）、actual（资料中实际值）、source（来源文档名 + 页码；若来自用户附件写「附件：文件名」）
- 实际值找不到时，actual 写「资料未提供」，verdict 写 "warn"
- 最后用 conclusion 给出综合结论与选型建议（哪款合适 / 差在哪里）

技术要求：
"""
PROMPT_CONTEXT = "\n\n可选资料：\n"
PROMPT_CLOSE = """

请严格只输出 JSON（不要 markdown 代码块、不要多余文字）：
{"model":"匹配到的树脂体系名","items":[{"item":"指标名","required":"要求","actual":"实际","verdict":"ok|no|warn","source":"来源"}],"conclusion":"综合结论与建议"}"""
# --- end of fixed values ---


def compliance_prompt(requirement: Column, context: Column) -> Column:
    return F.concat(F.lit(PROMPT_OPEN), requirement, F.lit(PROMPT_CONTEXT), context, F.lit(PROMPT_CLOSE))


def parsed_reply(raw: Column) -> Column:
    """struct<model, items, conclusion> from the outermost braces of a reply, null when that is not usable JSON."""
    s = trimmed(F.coalesce(raw, F.lit("")))
    start = F.instr(s, "{")
    end = F.length(s) - F.instr(F.reverse(s), "}") + 1
    braced = (start > 0) & F.contains(s, F.lit("}")) & (end > start)
    json = F.when(braced, F.substr(s, start, end - start + 1)).otherwise(s)
    reply = F.from_json(json, REPLY)
    text = lambda c: F.coalesce(c, F.lit(""))
    items = F.transform(
        reply["items"],
        lambda it: F.struct(
            text(it["item"]).alias("item"),
            text(it["required"]).alias("required"),
            text(it["actual"]).alias("actual"),
            F.when(it["verdict"].isin("ok", "no", "warn"), it["verdict"]).otherwise("warn").alias("verdict"),
            F.when(it["source"] != "", it["source"]).alias("source"),
        ),
    )
    usable = F.try_parse_json(json).isNotNull() & reply["items"].isNotNull()
    model = F.coalesce(F.when(reply["model"] != "", reply["model"]), F.lit(UNKNOWN_MODEL))
    return F.when(
        usable,
        F.struct(model.alias("model"), items.alias("items"), text(reply["conclusion"]).alias("conclusion")),
    )


def parse_replies(replies: DataFrame) -> DataFrame:
    """(reply_id, raw) with model, items and conclusion; unusable replies keep a row with nulls."""
    return replies.withColumn("_r", parsed_reply(F.col("raw"))).select(
        *replies.columns, F.col("_r.model").alias("model"), F.col("_r.items").alias("items"), F.col("_r.conclusion").alias("conclusion")
    )


def item_rows(parsed: DataFrame) -> DataFrame:
    """One row per item; a reply without items keeps one row of nulls."""
    return parsed.select(
        "reply_id", "model", F.posexplode_outer("items").alias("n", "it")
    ).select("reply_id", "model", "n", "it.*", F.col("it.actual").rlike(NO_DATA_PATTERN).alias("no_data"))


def verdict_counts(parsed: DataFrame) -> DataFrame:
    """(model, verdict, n, no_data): items by verdict, and how many say the library has no value."""
    return (
        item_rows(parsed)
        .filter(F.col("verdict").isNotNull())
        .groupBy("model", "verdict")
        .agg(F.count("*").alias("n"), F.count_if("no_data").alias("no_data"))
    )


def _csv_cell(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def compliance_csv() -> Column:
    row = lambda it: F.concat_ws(
        ",", *(_csv_cell(c) for c in (it["item"], it["required"], it["actual"], verdict_label(it["verdict"]), it["source"]))
    )
    end = F.concat(F.lit("结论,"), _csv_cell(F.col("conclusion")), F.lit(",模型,"), _csv_cell(F.col("model")))
    return F.array_join(F.concat(F.array(F.lit(CSV_HEAD)), F.transform("items", row), F.array(F.lit(""), end)), "\n")


def _md_cell(c: Column) -> Column:
    plain = F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(plain, "\n+", " ")


def compliance_markdown() -> Column:
    row = lambda it: F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ",
            *(_md_cell(it[c]) for c in ("item", "required", "actual")),
            verdict_label(it["verdict"]),
            _md_cell(it["source"]),
        ),
        F.lit(" |"),
    )
    end = F.array(
        F.lit(""), F.concat(F.lit("**结论**："), F.col("conclusion")), F.lit(""), F.concat(F.lit("模型："), F.col("model"))
    )
    return F.array_join(F.concat(F.array(F.lit(MARKDOWN_HEAD)), F.transform("items", row), end), "\n")


def compliance_export(parsed: DataFrame, fmt: str = "markdown") -> DataFrame:
    """(reply_id, text, ext) for the usable replies; the one place that decides the format."""
    text, ext = (compliance_markdown(), "md") if fmt == "markdown" else (compliance_csv(), "csv")
    return parsed.filter(F.col("items").isNotNull()).select("reply_id", text.alias("text"), F.lit(ext).alias("ext"))
