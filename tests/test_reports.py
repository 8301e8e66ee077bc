import json
import random

from pyspark.sql import functions as F

from folioseek.functions.labels import verdict_label
from folioseek.operators import access, compliance as cp, conversations as cv, library as lib, spans as sp
from folioseek.operators.tables import delete_cascade, first_seen, upsert
from folioseek.sources.reports import write_reports, write_sections

REPLY = {"model": "CY1578", "items": [{"item": "粘度|25", "required": "<2000", "actual": "1200\nmPa", "verdict": "ok", "source": "a.pdf"},
                                      {"item": "强度", "required": "100", "actual": "资料未提供", "verdict": "maybe"}], "conclusion": '可用 "A"'}


def replies(spark, *raws):
    return cp.parse_replies(spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "reply_id string, raw string"))


def test_parse_reply(spark):
    good = "好的：\n" + json.dumps(REPLY, ensure_ascii=False) + " 完"
    rows = replies(spark, good, "no json", '{"items": 3}', '{"items": []}', '{"items": [', "").orderBy("reply_id").collect()
    assert rows[0].model == "CY1578" and [i.verdict for i in rows[0]["items"]] == ["ok", "warn"] and rows[0]["items"][1].source is None
    assert [r["items"] for r in rows[1:]] == [None, None, [], None, None]
    assert rows[3].model == "未知" and rows[3].conclusion == ""
    counts = {(r.verdict, r.n, r.no_data) for r in cp.verdict_counts(replies(spark, good, "x")).collect()}
    assert counts == {("ok", 1, 0), ("warn", 1, 1)}


def test_exports(spark, tmp_path):
    parsed = replies(spark, json.dumps(REPLY, ensure_ascii=False), "x")
    csv = cp.compliance_export(parsed, "csv").collect()
    assert len(csv) == 1 and csv[0].text.split("\n") == [
        "项目,要求,实际,判定,来源", '"粘度|25","<2000","1200', 'mPa","满足","a.pdf"', '"强度","100","资料未提供","差一点",""', "",
        '结论,"可用 ""A""",模型,"CY1578"']
    md = cp.compliance_export(parsed).first()
    assert md.text.split("\n")[2] == "| 粘度\\|25 | <2000 | 1200 mPa | 满足 | a.pdf |" and md.ext == "md"
    write_reports(cp.compliance_export(parsed, "csv"), str(tmp_path / "r"))
    assert "结论" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "r")).collect())
    assert spark.range(1).select(verdict_label(F.lit("odd"))).first()[0] == "不满足"


def turns(spark, *rows):
    return spark.createDataFrame([("c", i, role, text) for i, (role, text) in enumerate(rows)], "conv_id string, turn long, role string, text string")


def test_titles_history_drafts(spark):
    t = turns(spark, ("ai", "hello"), ("user", "【需求符合性检查】树脂的混合粘度在二十五度时是多少"), ("ai", "a" * 1300), ("ai", "⚠️ 超时"), ("user", " "), ("ai", "见附件"))
    assert cv.titles(t).first().title == "树脂的混合粘度在二十五度时是…"
    history = cv.chat_history(t).orderBy("turn").collect()
    assert [h.role for h in history] == ["assistant", "user", "assistant", "user", "assistant"] and history[3].content == "（见本条附件）"
    drafts = {r.turn: r for r in cv.case_drafts(cv.answered_questions(t)).collect()}
    assert drafts[0].title == "（未填写问题）" and drafts[5].title == "（未填写问题）"
    assert drafts[2].problem == "树脂的混合粘度在二十五度时是多少" and len(drafts[2].ai_advice) == 1300
    cut = {r.turn: r for r in cv.case_drafts(cv.answered_questions(t), advice_chars=cv.ADVICE_CHARS).collect()}
    assert len(cut[2].ai_advice) == 1201


def test_nearest_question_across_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("user" if rng.random() < 0.15 else "ai", f"t{i}") for i in range(200)]
    want, last = {}, None
    for i, (role, text) in enumerate(rows):
        if role == "ai":
            want[i] = last
        else:
            last = text
    monkeypatch.setattr(cv, "BLOCK_TURNS", 7)
    assert {r.turn: r.question for r in cv.answered_questions(turns(spark, *rows)).collect()} == want


def test_conversation_sections(spark, tmp_path):
    t = turns(spark, ("user", "粘度"), ("ai", ""))
    quotes = spark.createDataFrame([("c", 1, 1, "a.pdf", 3, "粘度 1200")], "conv_id string, turn long, n int, doc_name string, page_no int, snippet string")
    files = spark.createDataFrame([("c", 0, 1, "图.png")], "conv_id string, turn long, n int, name string")
    parts = cv.conversation_markdown(t, quotes, files)
    assert [r.markdown for r in parts.orderBy("part").collect()] == [
        "# 粘度\n", "## 我\n\n粘度\n\n附件：图.png\n", "## 助手\n\n（无文字）\n\n引用来源：\n- [1] 《a.pdf》 第3页：粘度 1200\n"]
    write_sections(parts, str(tmp_path / "md"), ["conv_id", "part"])
    assert spark.read.text(str(tmp_path / "md")).count() > 5


def test_newest_conversations(spark):
    convs = spark.createDataFrame([(i, f"u{i % 2}") for i in range(80)], "conv_id int, owner string")
    assert [r.conv_id for r in cv.newest_conversations(convs, [F.col("conv_id").desc()]).collect()] == list(range(79, 49, -1))
    assert cv.newest_conversations(convs, [F.col("conv_id").desc()], owner="owner", n=3).count() == 6


SPAN = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, size double, text string"


def test_table_rows_stay_together(spark):
    cells = [(10, 10, 60, "性能项目"), (200, 10, 250, "单位"), (400, 10, 450, "数值"), (10, 40, 120, "混合粘度"), (200, 40, 260, "mPa·s"), (400, 40, 450, "1200")]
    df = spark.createDataFrame([("d", 1, float(x), float(y), float(e), y + 12.0, 12.0, s) for x, y, e, s in cells] + [("d", 1, 0.0, 99.0, 1.0, 111.0, 12.0, " ")], SPAN)
    assert sp.document_texts(sp.span_lines(df)).first().text == "性能项目 单位 数值\n混合粘度 mPa·s 1200"


def rows_one_by_one(page):
    """Row number of each span when a page is read from top to bottom."""
    out, number, anchor, largest = [], 0, None, None
    for y0, x0, y1, size in sorted(page):
        middle = (y0 + y1) / 2
        if number and abs(middle - anchor) <= 0.6 * max(size, largest):
            largest = max(largest, size)
        else:
            number, anchor, largest = number + 1, middle, size
        out.append(((y0, x0), number))
    return out


def test_span_rows_against_reading_in_order(spark):
    rng = random.Random(11)
    pages, rows = {}, []
    for p in range(40):
        spans = []
        for i in range(rng.randint(1, 60)):
            y0, size = round(rng.uniform(0, 200), 1), rng.choice([6.0, 10.0, 24.0])
            spans.append((y0, float(i), y0 + size * rng.choice([1.0, 1.3, 0.2]), size))
        pages[p] = rows_one_by_one(spans)
        rows += [("d", p, x, y, x + 0.5, y1, s, "w") for y, x, y1, s in spans]
    got = sp.span_rows(spark.createDataFrame(rows, SPAN)).collect()
    for p, want in pages.items():
        seen = {}
        for r in got:
            if r.page == p:
                seen[(r.y0, r.x0)] = (r.band, r.row)
        order = {k: i + 1 for i, k in enumerate(sorted(set(seen.values())))}
        assert {k: order[v] for k, v in seen.items()} == dict(want)


def test_library_edits(spark):
    docs = spark.createDataFrame([("a", "n", False, ["x"], "A", "m", "tds"), ("b", "n", True, [], None, None, None)],
                                 "doc_id string, name string, pinned boolean, tags array<string>, category string, model string, kind string")
    ids = docs.filter("doc_id = 'a'")
    one = lambda df: {r.doc_id: r for r in df.collect()}
    assert one(lib.add_tags(docs, ids, [" y ", "x", ""]))["a"].tags == ["x", "y"]
    assert one(lib.set_category(docs, ids, " "))["a"].category is None
    assert one(lib.rename_category(docs, "A", "B"))["a"].category == "B"
    patch = spark.createDataFrame([("a", "", None, "C")], "doc_id string, model string, kind string, category string")
    patched = one(lib.update_labels(docs, patch))
    assert (patched["a"].model, patched["a"].kind, patched["a"].category, patched["b"].model) == (None, "tds", "C", None)
    assert lib.valid_category(" A ", ["A"]) == "A" and lib.valid_category("A", []) is None
    assert [r.label for r in lib.grouped(docs, "kind").collect()] == ["TDS", "未分组"]


def test_upsert_delete_first_seen(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, at int")
    got = upsert(base.withColumn("at", F.lit(0)), new, ["id"], [F.col("at")])
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, "a"), (2, "d"), (3, "e")]
    left = delete_cascade(base.filter("id = 1"), {"t": base, "u": new}, "id")
    assert (left["t"].count(), left["u"].count()) == (1, 3)
    assert first_seen(new, ["id"], [F.col("at")]).filter("id = 2").first().v == "c"


def test_access(spark):
    users = spark.createDataFrame([("u1", "ann", "admin", None, False), ("u2", "bob", "user", None, True), ("u3", "eve", "admin", None, False)],
                                  "id string, username string, role string, note string, disabled boolean").withColumn("created_at", F.to_timestamp(F.lit("2024-01-01")))
    made = [("1", "u1", "app", "good", None, False), ("2", "u1", "api", "old", "2024-01-01", False), ("3", "u1", "app", "gone", None, True), ("4", "u2", "app", "off", None, False), ("5", "u9", "api", "lost", None, False)]
    creds = spark.createDataFrame(made, "id string, user_id string, kind string, secret string, ends string, revoked boolean")
    creds = creds.withColumns({"secret_hash": F.sha2("secret", 256), "prefix": F.col("secret"), "name": F.lit(None).cast("string"), "last_used_at": F.lit(None).cast("timestamp"),
                               "expires_at": F.to_timestamp("ends"), "created_at": F.to_timestamp(F.lit("2024-01-01"))})
    shown = spark.createDataFrame([(t, t) for t in ("good", "old", "gone", "off", "lost", "never")] + [("none", None)], "request_id string, token string")
    status = {r.request_id: r.status for r in access.credential_status(shown, creds, users, F.to_timestamp(F.lit("2024-01-02"))).collect()}
    assert status == {"good": "ok", "old": "expired", "gone": "revoked", "off": "disabled", "lost": "disabled", "never": "unknown", "none": "missing"}
    counts = {r.id: (r.tokens, r.api_keys) for r in access.users_with_counts(users, creds).collect()}
    assert counts == {"u1": (1, 1), "u2": (1, 0), "u3": (0, 0)}
    listed = access.visible_credentials(creds, users, "api", "u1", True)
    assert "secret_hash" not in listed.columns and {r.username for r in listed.collect()} == {"ann", "?"}
    assert [r.id for r in access.visible_credentials(creds, users, "app", "u2", False).collect()] == ["4"]
    assert access.other_admins(users, "u1").first().n == 1
    left, owned = access.delete_users(users.filter("id = 'u1'"), users, creds)
    assert left.count() == 2 and sorted(r.id for r in owned.collect()) == ["4", "5"]
    head = spark.createDataFrame([("Bearer  abc ",), ("bearer x",), ("Basic x",), (None,)], "h string")
    assert [r.t for r in head.select(access.bearer_token(F.col("h")).alias("t")).collect()] == ["abc", "x", None, None]


def test_one_heading_does_not_join_lines(spark):
    lines = [("d", 1, 0.0, 14.0 * i, 50.0, 14.0 * i + 12, 12.0, "w") for i in range(200)]
    heading = [("d", 1, 0.0, 14.0 * 200 + 40, 90.0, 14.0 * 200 + 70, 30.0, "H")]
    got = sp.span_rows(spark.createDataFrame(lines + heading, SPAN))
    assert got.select("band").distinct().count() >= 195


def test_one_giant_page(spark, monkeypatch):
    """Ranges of cells give the same rows as one range."""
    rng = random.Random(4)
    spans = [("d", 1, float(i % 5), 9.0 * (i // 5) + rng.random() * 4, 1.0, 9.0 * (i // 5) + 8 + rng.random(), rng.choice([8.0, 9.0, 14.0]), "w") for i in range(4000)]
    df = spark.createDataFrame(spans, SPAN)
    view = lambda: [tuple(r) for r in sp.span_rows(df).select("band", "row", "y0", "x0").orderBy("band", "row", "y0", "x0").collect()]
    whole = view()
    monkeypatch.setattr(sp, "CELLS", 16)
    assert view() == whole and len({r[:2] for r in whole}) > 300
