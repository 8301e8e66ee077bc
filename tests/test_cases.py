from pyspark.sql import functions as F

from folioseek.operators import cases as cs
from tests.test_retrieval import case_rows


def variants(spark):
    base = case_rows(spark)
    return (
        base.unionByName(case_rows(spark, case_id="c2", verified=False))
        .unionByName(case_rows(spark, case_id="c3", final_fix=""))
        .unionByName(case_rows(spark, case_id="c4", outcome="fail", tags=["气泡"], occurred_at=None, created_at="2026-01-01 00:00:00"))
        .unionByName(case_rows(spark, case_id="c5", outcome="partial", notes="小心", environment="A 线"))
    )


def test_gate_and_corpus(spark):
    rows = {r.doc_id: r for r in cs.case_corpus(variants(spark)).collect()}
    assert set(rows) == {"case:c1", "case:c4", "case:c5"}
    assert rows["case:c1"].content == (
        "【已验证案例 · 成功】CY1578 混合料气泡\n产品/型号：CY1578 / HY1578\n根因：脱泡时间不足\n"
        "最终解决：升温 60℃ 抽真空 30 min，静置 5 min 后浇注\n结果：成功\n标签：气泡 工艺\n记录时间：2025-08-12"
    )
    assert "产品/型号：CY1578 / HY1578｜环境：A 线" in rows["case:c5"].content and "\n注意：小心\n" in rows["case:c5"].content
    assert rows["case:c4"].content.startswith("【已验证案例 · 失败 · 此路不通，不要照做】") and "最终解决" not in rows["case:c4"].content


def test_unknown_outcome_gets_a_neutral_header(spark):
    text = case_rows(spark, outcome=None).select(cs.case_text().alias("t")).first().t
    assert text.startswith("【已验证案例】CY1578")


def test_statistics_and_order(spark):
    v = variants(spark)
    assert cs.case_stats(v).first().asDict() == {"total": 5, "success": 3, "partial": 1, "fail": 1}
    assert cs.case_totals(v).first().asDict() == {"total": 5, "verified": 4}
    assert [(r.tag, r.n) for r in cs.tag_counts(v).collect()] == [("气泡", 5), ("工艺", 4)]
    assert [r.case_id for r in cs.newest_first(v).collect()][0] == "c4"


def test_list_filter(spark):
    v = variants(spark)
    ids = lambda df: sorted(r.case_id for r in df.collect())
    assert ids(cs.filter_cases(v, outcome="fail")) == ["c4"]
    assert ids(cs.filter_cases(v, only_unverified=True)) == ["c2"]
    assert ids(cs.filter_cases(v, text=" hy1578 ")) == ["c1", "c2", "c3", "c4", "c5"]
    assert ids(cs.filter_cases(v, text="A 线")) == ["c5"]
    assert ids(cs.filter_cases(v, text="没有")) == []


def test_validation(spark):
    error = lambda **c: case_rows(spark, **c).select(cs.case_error().alias("e")).first().e
    assert error() is None
    assert error(final_fix=" ").startswith("请填写「最终怎么解决的」")
    assert error(final_fix="", outcome="fail").startswith("请填写「试过什么")
    assert error(outcome=None) == "请选择结果（成功 / 部分成功 / 失败）"
    assert error(outcome="odd") == "结果取值不合法"
    assert error(final_fix="x" * 8001, outcome="fail") == "「试过的做法（未成功）」过长（上限 8000 字）"


def test_completion_keeps_the_record(spark):
    none = F.lit(None).cast("string")
    whole = lambda df: df.withColumns({"doc_ids": F.array(F.lit("d1")), "ai_advice": none, "conv_id": F.lit("v"), "msg_id": none})
    base = whole(case_rows(spark))
    edit = base.withColumns(
        {"title": F.lit(" "), "problem": F.lit(" 新现象 "), "final_fix": F.lit(" 换料 "), "verified": F.lit(None).cast("boolean"),
         "created_at": F.current_timestamp(), "doc_ids": F.lit(None).cast("array<string>")}
    )
    done = cs.complete_cases(edit, base).first()
    assert (done.title, done.problem, done.final_fix, done.verified, done.doc_ids) == ("CY1578 混合料气泡", "新现象", "换料", True, ["d1"])
    assert str(done.created_at) == "2025-08-13 00:00:00"
    new = cs.complete_cases(whole(case_rows(spark, title="", problem="x" * 100))).first()
    assert new.title == "x" * 80


def test_markdown_numbers_the_whole_table(spark):
    rows = cs.case_markdown(variants(spark).repartition(3)).orderBy("place").collect()
    assert [r.place for r in rows] == [1, 2, 3, 4, 5] and rows[0].case_id == "c4"
    assert rows[2].markdown.startswith("## 3. CY1578 混合料气泡\n\n- 结果：成功（未参与检索）\n- 产品 / 型号：")
