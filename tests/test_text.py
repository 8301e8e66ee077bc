import pytest
from pyspark.sql import functions as F

from folioseek.functions import net, quality, text
from folioseek.functions.classify import classify, pick_model


@pytest.mark.parametrize(
    "given, index, query",
    [
        ("CY-1578", ["cy", "1578", "cy1578"], ["cy", "1578", "cy1578"]),
        ("ＣＹ１５７８", ["cy1578"], ["cy1578"]),
        ("适用期", ["适", "用", "期", "适用", "用期"], ["适用", "用期"]),
        ("苯", ["苯"], ["苯"]),
        ("mPa·s", ["mpa", "s", "mpas"], ["mpa", "s", "mpas"]),
        ("---", [], []),
        ("", [], []),
        ("naïve", ["na", "ve"], ["na", "ve"]),
        ("CY-1578 的粘度 g/cm3", None, ["cy", "1578", "cy1578", "的粘", "粘度", "g", "cm3", "gcm3"]),
    ],
)
def test_tokens(value, given, index, query):
    if index is not None:
        assert sorted(value(text.index_tokens, given)) == sorted(index)
    assert value(text.query_tokens, given) == query


def test_trim_uses_the_wide_white_space_set(value):
    assert value(text.trimmed, "　﻿  a b 　\n") == "a b"
    assert value(text.blank, "　 \t")


def test_flat(value):
    assert value(text.flat, "ＣＹ-1578 树脂 (A)") == "cy1578树脂a"


def test_compat_fold(value):
    assert value(text.compat_folded, "⽤⼯") == "用工"
    assert value(text.compat_folded, "，（）Araldite CY1578") == "，（）Araldite CY1578"


def test_split_tags(value):
    assert value(text.split_tags, "气泡、工艺, CY1578  气泡") == ["气泡", "工艺", "CY1578"]
    assert value(lambda c: text.split_tags(c, on_space=False), "a b，c、 ,c") == ["a b", "c"]


def test_fingerprint_samples_only_where_asked(value):
    middle = lambda ch: "a" * 60_000 + ch * 10 + "b" * 60_000
    sampled = lambda c: text.fingerprint(c, side=text.FINGERPRINT_SIDE)
    assert value(sampled, middle("x")) == value(sampled, middle("y"))
    assert value(text.fingerprint, middle("x")) != value(text.fingerprint, middle("y"))
    assert value(text.fingerprint, "ab") != value(text.fingerprint, "ba")
    assert value(text.fingerprint, "") is None


def test_paragraphs(value):
    assert value(text.rejoined_paragraphs, "may\ncause\n\n环氧\n树脂\n a，\n\n\n") == "may cause\n\n环氧树脂a，"


@pytest.mark.parametrize("n, shown", [(0, ""), (10, "10 B"), (1536, "2 KB"), (1024 * 1024 * 5 // 2, "2.5 MB")])
def test_size_text(spark, n, shown):
    assert spark.range(1).select(text.size_text(F.lit(n))).first()[0] == shown


@pytest.mark.parametrize(
    "name, body, model, kind",
    [
        ("Araldite CY1578 TDS.pdf", "", "CY1578", "tds"),
        ("CY-1578 树脂.pdf", "", "CY1578", None),
        ("HY 5192.pdf", "", "HY5192", None),
        ("CY5192-HY5192 体系说明.pdf", "", "CY5192", None),
        ("CY1578树脂.pdf", "", "CY1578", None),
        ("环氧树脂技术资料.pdf", "CY1578 和 CY1578，以及 CY1578", "CY1578", None),
        ("x.pdf", "CY1578", None, None),
        ("x.pdf", "ISO 9001 ISO 9001 GB 19001", None, None),
        ("x.pdf", "ASTM D638 ASTM D638", None, None),
        ("CY1578 技术数据表.pdf", "", "CY1578", "tds"),
        ("拉挤工艺采购规格书.pdf", "", None, "spec"),
        ("CY5192 检验报告.pdf", "", "CY5192", "report"),
        ("HY1578 COA.pdf", "", "HY1578", "report"),
        ("CY1578 MSDS.pdf", "", "CY1578", "sds"),
        ("资料.pdf", "Technical Data Sheet", None, "tds"),
        ("随手拍的照片.pdf", "一些文字", None, None),
        ("Specifications.pdf", "", None, None),
    ],
)
def test_classify(value, name, body, model, kind):
    assert tuple(value(lambda n, t: F.struct(*classify(n, t)), name, body)) == (model, kind)


def test_model_scan_reads_whole_texts_unless_asked(value):
    late = "x" * 3000 + " CY1578 CY1578"
    assert value(pick_model, late) == "CY1578"
    assert value(lambda c: pick_model(c, scan_chars=3000), late) is None


@pytest.mark.parametrize(
    "url, private",
    [
        ("http://[::1]:8081", True),
        ("http://localhost:8787/parse", True),
        ("http://nas:5005", True),
        ("https://user:pw@10.0.0.1/x", True),
        ("http://172.31.0.1", True),
        ("http://172.32.0.1", False),
        ("https://box.LOCAL/a", True),
        ("https://api.example.com/v1", False),
        ("api.example.com/v1", False),
        ("not a url", False),
        ("", False),
    ],
)
def test_private_hosts(value, url, private):
    assert value(net.is_private_host, url) is private


def test_quality(value):
    score = lambda p: lambda c: quality.service_quality(c, F.lit(p))
    assert value(score(1), "") == 0.0
    assert value(score(1), "x" * 30) < 0.5
    assert value(score(2), "x" * 3000) >= 0.9
    low = value(lambda c: quality.paged_quality(c, F.lit(1)), "x" * 10)
    assert not low["has_text"] and low["note"] == quality.NOTE_NO_TEXT_LAYER
    assert value(quality.flow_quality, "正文内容足够长的一段文字")["quality"] == 1.0


def test_service_quality_rounds_the_binary_value(spark):
    n = spark.range(60, 2500).select("id", quality.service_quality(F.repeat(F.lit("x"), F.col("id").cast("int")), F.lit(1)).alias("q"))
    for r in n.collect():
        assert r.q == round(min(1.0, 0.88 + r.id / 20000), 2), r.id
