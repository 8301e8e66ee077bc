"""Conversations, one row per turn: (conv_id, turn, role user/ai, text)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import COMPLIANCE_PREFIX
from ..functions.text import blank, clipped, trimmed
from .tables import row_top

# --- fixed values ---
TITLE_CHARS, DRAFT_TITLE_CHARS, ADVICE_CHARS = 14, 30, 1200
NEW_TITLE, NO_QUESTION = "新会话", "（未填写问题）"
KEPT_CONVERSATIONS = 30
ERROR_MARK = "⚠️"
SEE_ATTACHMENT, NO_TEXT = "（见本条附件）", "（无文字）"
HEAD_USER, HEAD_AI = "## 我", "## 助手"
# --- end of fixed values ---

BLOCK_TURNS = 4096  # turns of one conversation that a task handles together


def _asked(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{COMPLIANCE_PREFIX}", "")


def titles(turns: DataFrame) -> DataFrame:
    """(conv_id, title): the opening of the first question."""
    first = turns.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("text")
    )
    q = _asked(F.col("text"))
    return first.select("conv_id", F.when(q == "", NEW_TITLE).otherwise(clipped(q, TITLE_CHARS)).alias("title"))


def newest_conversations(convs: DataFrame, order: list[Column], owner: str | None = None, n: int = KEPT_CONVERSATIONS) -> DataFrame:
    """The newest `n` conversations, of each owner if there are owners."""
    if owner is None:
        return convs.orderBy(*order).limit(n)
    return row_top(convs, [owner], order, n).drop("rank")


def chat_history(turns: DataFrame) -> DataFrame:
    """What is sent to a model: failed answers left out, roles renamed, a blank turn points to its attachment."""
    failed = (F.col("role") == "ai") & F.coalesce(F.col("text").startswith(ERROR_MARK), F.lit(False))
    return turns.filter(F.col("role").isin("user", "ai") & ~failed).select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "ai", "assistant").otherwise("user").alias("role"),
        F.when(blank(F.col("text")), SEE_ATTACHMENT).otherwise(F.col("text")).alias("content"),
    )


def answered_questions(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each answer with the nearest question before it.

    Windows run over blocks of turns, so one huge conversation is still many tasks. The last
    question of the blocks before is carried in from one summary row per block.
    """
    question = F.when(F.col("role") == "user", F.coalesce("text", F.lit("")))
    cut = turns.withColumns({"block": F.floor(F.col("turn") / BLOCK_TURNS), "question": question})
    asked_at = F.when(F.col("question").isNotNull(), F.col("turn"))
    ends = cut.groupBy("conv_id", "block").agg(F.max_by("question", asked_at).alias("carried"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("conv_id", "block", F.last("carried", ignorenulls=True).over(earlier).alias("carried"))
    before = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("near", F.last("question", ignorenulls=True).over(before))
    return (
        near.filter(F.col("role") == "ai")
        .join(carried, ["conv_id", "block"], "left")
        .select("conv_id", "turn", F.coalesce("near", "carried").alias("question"), F.col("text").alias("answer"))
    )


def case_drafts(answered: DataFrame, quoted: DataFrame | None = None, advice_chars: int | None = None) -> DataFrame:
    """Drafts for case records from answered questions, with the documents the answer quoted.

    `quoted` is (conv_id, turn, doc_id, kind); cases among the quotes are not documents. The advice is the whole
    answer, or cut to `advice_chars` (ADVICE_CHARS in the system we match).
    """
    q = trimmed(_asked(F.col("question")))
    advice = trimmed(F.coalesce("answer", F.lit("")))
    drafts = answered.select(
        "conv_id",
        "turn",
        F.when(q == "", NO_QUESTION).otherwise(clipped(q, DRAFT_TITLE_CHARS)).alias("title"),
        q.alias("problem"),
        (advice if advice_chars is None else clipped(advice, advice_chars)).alias("ai_advice"),
    )
    if quoted is None:
        return drafts
    docs = (
        quoted.filter(F.col("kind") != "case")
        .groupBy("conv_id", "turn")
        .agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    )
    return drafts.join(docs, ["conv_id", "turn"], "left")


def conversation_markdown(turns: DataFrame, quotes: DataFrame | None = None, attachments: DataFrame | None = None) -> DataFrame:
    """(conv_id, part, markdown): the title as part -1, then one section per turn.

    Sections stay rows, so a conversation of any length is written in order without being held as one value.
    `quotes` is (conv_id, turn, n, doc_name, page_no, snippet); `attachments` is (conv_id, turn, n, name).
    """
    head = titles(turns).select("conv_id", F.lit(-1).cast("long").alias("part"), F.concat(F.lit("# "), "title", F.lit("\n")).alias("markdown"))
    body = turns.filter(F.col("role").isin("user", "ai"))
    keys = ["conv_id", "turn"]
    files = listed = F.lit(None).cast("string")
    if attachments is not None:
        named = F.array_sort(F.collect_list(F.struct("n", "name")))
        body = body.join(attachments.groupBy(*keys).agg(named.alias("files")), keys, "left")
        names = F.array_join(F.transform("files", lambda f: f["name"]), "、")
        files = F.when(F.size("files") > 0, F.concat(F.lit("\n附件："), names))
    if quotes is not None:
        page = F.when(F.coalesce("page_no", F.lit(0)) != 0, F.concat(F.lit(" 第"), F.col("page_no"), F.lit("页"))).otherwise("")
        line = F.concat(F.lit("- ["), "n", F.lit("] 《"), "doc_name", F.lit("》"), page, F.lit("："), "snippet")
        packed = F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))
        body = body.join(quotes.groupBy(*keys).agg(packed.alias("quoted")), keys, "left")
        lines = F.array_join(F.transform("quoted", lambda q: q["line"]), "\n")
        listed = F.when(F.size("quoted") > 0, F.concat(F.lit("\n引用来源：\n"), lines))
    heading = F.when(F.col("role") == "user", HEAD_USER).otherwise(HEAD_AI)
    text = F.when(F.coalesce("text", F.lit("")) == "", NO_TEXT).otherwise(F.col("text"))
    sections = body.select(
        "conv_id", F.col("turn").cast("long").alias("part"), F.concat_ws("\n", heading, F.lit(""), text, files, listed, F.lit("")).alias("markdown")
    )
    return head.unionByName(sections)
