"""Fixed wording for kinds, outcomes, verdicts and sources."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
KIND_LABEL = {"tds": "TDS", "spec": "规格书", "report": "检验报告", "sds": "安全表", "other": "未分类"}
OUTCOME_LABEL = {"success": "成功", "partial": "部分成功", "fail": "失败"}
OUTCOME_VERDICT = {"success": "ok", "partial": "warn", "fail": "no"}
VERDICT_LABEL = {"ok": "满足", "no": "不满足", "warn": "差一点"}
CASE_HEADER = {
    "success": "【已验证案例 · 成功】",
    "partial": "【已验证案例 · 部分成功】",
    "fail": "【已验证案例 · 失败 · 此路不通，不要照做】",
}
CASE_HEADER_UNKNOWN = "【已验证案例】"
CASE_SOURCE = {
    "success": "你已验证的经验案例",
    "partial": "你已验证的经验案例（部分成功）",
    "fail": "你的失败记录（试过，没成）",
}
FIX_LABEL, FIX_LABEL_FAILED = "最终解决", "试过的做法（未成功）"
CASE_ID_PREFIX = "case:"
CASE_NAME_PREFIX = "案例 · "
UNTITLED = "(未命名)"
UNTITLED_CASE = "（未命名案例）"
DELETED_NAME = "(已删除)"
UNKNOWN_NAME = "?"
UNGROUPED = "未分组"
COMPLIANCE_PREFIX = "【需求符合性检查】"
NO_DATA_PATTERN = "资料未提供|未提供|未列"
# --- end of fixed values ---


def mapped(c: Column, table: dict[str, str], default: Column | str | None = None) -> Column:
    """`table[c]`, or `default` (the value itself when None) for anything not listed."""
    items = [F.lit(x) for pair in table.items() for x in pair]
    fallback = c if default is None else (F.lit(default) if isinstance(default, str) else default)
    return F.coalesce(F.element_at(F.create_map(*items), c), fallback)


def verdict_label(verdict: Column) -> Column:
    """Export wording: anything that is neither ok nor warn reads as not met."""
    return (
        F.when(verdict == "ok", VERDICT_LABEL["ok"])
        .when(verdict == "warn", VERDICT_LABEL["warn"])
        .otherwise(VERDICT_LABEL["no"])
    )


def fix_label(outcome: Column) -> Column:
    return F.when(outcome == "fail", FIX_LABEL_FAILED).otherwise(FIX_LABEL)


def is_case(doc_id: Column) -> Column:
    return F.coalesce(doc_id.startswith(CASE_ID_PREFIX), F.lit(False))


def case_id_of(doc_id: Column) -> Column:
    return F.when(is_case(doc_id), F.substr(doc_id, F.lit(len(CASE_ID_PREFIX) + 1)))


def without_case_prefix(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), f"^{CASE_NAME_PREFIX}", "")
