import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioseek.functions.text import index_tokens, query_tokens
from folioseek.operators import blocks
from folioseek.operators import context as cx
from folioseek.operators.cases import case_names, library_corpus
from folioseek.operators.fuse import fuse
from folioseek.operators import index as ix
from folioseek.operators import keyword
from folioseek.operators.index import build_index, occurrences, scratch_index
from folioseek.operators.keyword import keyword_search
from folioseek.operators.library import search_all
from folioseek.operators.scope import Scope, resolve_scope, scoped_counts, signatures
from folioseek.operators.semantic import cosine, embed_corpus, embedding_stats, semantic_search, vector_rows
from folioseek.plans.retrieve import hybrid_retrieve

CHUNKS = [
    ("d1", 0, "混合粘度（25°C） mPa·s 1200 ISO 3219"),
    ("d1", 1, "弯曲强度 MPa 118 ISO 178"),
    ("d1", 2, "储存条件：原包装密封，存放于 5-25°C 阴凉干燥处。保质期自生产日期起 24 个月。"),
    ("d2", 0, "固化剂 HY1578 的推荐用量为树脂重量的 80 份。"),
    ("d2", 1, "混合时请充分搅拌 3 分钟，注意放热。"),
]
QUERY = "query_id string, text string, top_k int, only_pinned boolean, scope_category string, scope_tags array<string>, query_vec array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "doc_id string, seq int, content string").withColumn("page_no", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def index(chunks):
    return scratch_index(chunks, "fixture")


def docs(spark, pinned=()):
    rows = [(d, d in pinned, "c-" + d, [d], n) for d, n in (("d1", "Araldite CY1578 TDS"), ("d2", "HY1578 固化剂说明书"))]
    return spark.createDataFrame(rows, "doc_id string, pinned boolean, category string, tags array<string>, name string")


def ask(spark, text, k=4, only_pinned=False, category=None, tags=None, vec=None):
    return spark.createDataFrame([("q", text, k, only_pinned, category, tags, vec)], QUERY)


def rows(df):
    return df.orderBy("query_id", "rank").collect()


def test_finds_and_names(spark, index):
    hits = hybrid_retrieve(index, docs(spark), ask(spark, "这个树脂的粘度是多少", 3))
    named = rows(cx.with_names_and_outcomes(hits, docs(spark)))
    assert "混合粘度" in named[0].content and named[0].doc_name == "Araldite CY1578 TDS"


def test_pinned_rows_come_first_and_are_extra(spark, index):
    hits = rows(hybrid_retrieve(index, docs(spark, ["d2"]), ask(spark, "弯曲强度")))
    assert [h.doc_id for h in hits[:2]] == ["d2", "d2"] and all(h.pinned for h in hits[:2])
    assert any("弯曲强度" in h.content and not h.pinned for h in hits)


def test_scope_of_hybrid(spark, index):
    only_d2 = rows(hybrid_retrieve(index, docs(spark), ask(spark, "粘度 固化剂", tags=["d2"])))
    assert only_d2 and {h.doc_id for h in only_d2} == {"d2"}
    assert rows(hybrid_retrieve(index, docs(spark), ask(spark, "粘度", tags=["none"]))) == []
    kept = rows(hybrid_retrieve(index, docs(spark, ["d1"]), ask(spark, "粘度", category="none")))
    assert kept and all(h.pinned for h in kept)


def test_nothing_to_find(spark, index):
    assert rows(hybrid_retrieve(index, docs(spark), ask(spark, "  "))) == []
    assert rows(hybrid_retrieve(index, docs(spark), ask(spark, "完全不存在的词xyzzy"))) == []
    assert len(rows(hybrid_retrieve(index, docs(spark), ask(spark, "固化 粘度 混合 强度", 2)))) <= 2


VECTORS = [("d1", 0, [0.0, 1.0, 0.0]), ("d1", 1, [0.0, 1.0, 0.0]), ("d2", 0, [0.0, 1.0, 0.0]), ("d1", 2, [0.99, 0.1, 0.0]), ("d2", 1, [1.0, 0.0]), ("gone", 0, [1.0, 0.0, 0.0])]


def test_semantic_list(spark, index):
    vectors = spark.createDataFrame(VECTORS, "doc_id string, seq int, vec array<float>")
    top = rows(hybrid_retrieve(index, docs(spark), ask(spark, "有效期是多久", vec=[1.0, 0.0, 0.0]), vectors))
    assert (top[0].doc_id, top[0].seq, top[0].sources) == ("d1", 2, ["semantic"])
    assert "gone" not in {h.doc_id for h in top}
    both = rows(hybrid_retrieve(index, docs(spark), ask(spark, "弯曲强度", vec=[0.0, 1.0, 0.0]), vectors))
    assert both[0].seq == 1 and both[0].sources == ["keyword", "semantic"]
    alone = rows(hybrid_retrieve(index, docs(spark), ask(spark, "弯曲强度"), vectors))
    assert alone[0].sources == ["keyword"]


def case_rows(spark, **changes):
    base = dict(
        case_id="c1", title="CY1578 混合料气泡", problem=None, product="CY1578 / HY1578", environment=None, root_cause="脱泡时间不足",
        final_fix="升温 60℃ 抽真空 30 min，静置 5 min 后浇注", outcome="success", notes=None, tags=["气泡", "工艺"], verified=True,
        occurred_at="2025-08-12 09:05:00", created_at="2025-08-13 00:00:00",
    )
    kinds = {"tags": "array<string>", "verified": "boolean"}
    schema = ", ".join(f"{k} {kinds.get(k, 'string')}" for k in base)
    df = spark.createDataFrame([tuple({**base, **changes}.values())], schema)
    return df.withColumns({c: F.to_timestamp(c) for c in ("occurred_at", "created_at")})


def test_cases_lead_and_ignore_the_scope(spark):
    texts = ["真空脱泡：建议 40 min，温度 60℃，静置后浇注可减少气泡。", "储存条件：密封避光，保质期自生产日期起 24 个月。"]
    chunks = spark.createDataFrame([("d1", i, t, None) for i, t in enumerate(texts)], "doc_id string, seq int, content string, page_no int")
    cases = case_rows(spark, outcome="fail")
    index = scratch_index(library_corpus(chunks, cases), "cases")
    hits = rows(hybrid_retrieve(index, docs(spark), ask(spark, "真空脱泡 气泡", tags=["d1"])))
    assert (hits[0].doc_id, hits[0].sources, hits[0].kind, hits[0].case_id) == ("case:c1", ["case"], "case", "c1")
    assert any(h.doc_id == "d1" for h in hits)
    assert all(h.kind != "case" for h in rows(hybrid_retrieve(index, docs(spark), ask(spark, "保质期 多久"))))
    outside = rows(hybrid_retrieve(index, docs(spark), ask(spark, "真空脱泡 气泡", tags=["none"])))
    assert [h.doc_id for h in outside] == ["case:c1"]
    names = docs(spark).select("doc_id", "name").unionByName(case_names(cases))
    named = cx.with_names_and_outcomes(hybrid_retrieve(index, docs(spark), ask(spark, "真空脱泡 气泡")), names, cases)
    text = cx.build_context(named, ask(spark, "x")).first().context
    assert text.startswith("[来源1] 【你的失败记录（试过，没成）】CY1578 混合料气泡\n【已验证案例 · 失败 · 此路不通，不要照做】")
    assert "试过的做法（未成功）：" in text and "最终解决" not in text
    badges = {r.rank: r.b for r in named.select("rank", cx.badge().alias("b")).collect()}
    assert badges[1] == "失败案例"


def library(spark, n=120):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["the"] * 30 + ["粘度", "固化", "CY-1578"]
    made = [(f"d{i % 17}", i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(n)]
    made += [("copy", i, made[3][2]) for i in range(5)]
    asked = [(i, " ".join(rng.choices(words, k=6))) for i in range(12)] + [(90, made[3][2]), (91, "nothing-here"), (92, made[7][2][:25])]
    return made, asked


def brute_bm25(spark, made, asked, depth):
    """Scores by counting in Python; tokens come from the library, which has its own tests."""
    flatten = lambda s: "".join(c for c in s.lower() if c.isalnum())
    cdf = spark.createDataFrame(made, "doc_id string, seq int, content string")
    bags = {(r.doc_id, r.seq): Counter(r.t) for r in cdf.select("doc_id", "seq", index_tokens(cdf.content).alias("t")).collect()}
    qdf = spark.createDataFrame(asked, "query_id int, text string")
    terms = {r.query_id: r.t for r in qdf.select("query_id", query_tokens(qdf.text).alias("t")).collect()}
    n, texts = len(made), {(d, s): c for d, s, c in made}
    size = {k: max(1, sum(b.values())) for k, b in bags.items()}
    mean = sum(size.values()) / n
    df = Counter(t for b in bags.values() for t in b)
    out = {}
    for q, text in asked:
        found = []
        for key, bag in bags.items():
            total = sum(
                math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * size[key] / mean))
                for t in terms[q] if t in bag
            )
            if total > 0:
                phrase = flatten(text)
                found.append((total + (2.5 if len(phrase) >= 2 and phrase in flatten(texts[key]) else 0), key))
        found.sort(key=lambda f: (-round(f[0], 9), f[1]))
        out[q] = [(k, round(s, 6)) for s, k in found[:depth]]
    return out


def as_frames(spark, made, asked):
    cdf = spark.createDataFrame(made, "doc_id string, seq int, content string").withColumn("page_no", F.lit(1))
    return cdf, spark.createDataFrame(asked, "query_id int, text string")


def test_bm25_equals_brute_force(spark):
    made, asked = library(spark)
    want = brute_bm25(spark, made, asked, 7)
    cdf, qdf = as_frames(spark, made, asked)
    for parts in (1, 5):
        index = scratch_index(cdf.repartition(parts), "brute")
        got = {q: [] for q, _ in asked}
        for r in rows(keyword_search(index, qdf, 7)):
            got[r.query_id].append(((r.doc_id, r.seq), round(r.raw, 6)))
        assert got == want


def test_postings_hold_every_token_once(spark, monkeypatch):
    made, asked = library(spark)
    cdf, _ = as_frames(spark, made, asked)
    monkeypatch.setattr(ix, "BLOCK", 16)
    index = scratch_index(cdf.repartition(3), "lists")
    got = Counter({(r.chunk_no, r.term): r.tf for r in occurrences(index).collect()})
    want = Counter((r.chunk_no, t) for r in index.corpus.collect() for t in r.tokens)
    assert got == want
    for r in index.postings.collect():
        factors = [ix.term_part(tf, dl, index.avgdl) for tf, dl in zip(r.tf, r.dl)]
        assert r.at == sorted(set(r.at)) and r.most == pytest.approx(max(factors))
    order = [(r.doc_id.startswith("case:"), r.doc_id, r.seq) for r in index.corpus.orderBy("chunk_no").collect()]
    assert order == sorted(order)


@pytest.mark.parametrize("step, batch", [(1, 1), (7, 3), (2048, 10_000)])
def test_tasks_emit_at_most_depth_rows_per_query(spark, monkeypatch, step, batch):
    """Whatever the size of slices and batches, equal scores included."""
    rng = random.Random(8)
    vecs = [(f"d{i}", 0, [float(rng.randint(-1, 1)) for _ in range(3)], "t", 1) for i in range(400)]
    held = spark.createDataFrame(vecs, "doc_id string, seq int, vec array<float>, content string, page_no int").repartition(4)
    asked = [(i, "t", [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(20)]
    qdf = spark.createDataFrame(asked, "query_id int, text string, query_vec array<float>")
    want = [tuple(r) for r in rows(semantic_search(held, qdf, 6))]
    emitted = []
    inner = blocks.written
    monkeypatch.setattr(blocks, "written", lambda df, label: emitted.append((label, inner(df, label))) or emitted[-1][1])
    monkeypatch.setattr(blocks, "CELLS", step * len(asked))
    with blocks.arrow_rows(spark, batch):
        assert [tuple(r) for r in rows(semantic_search(held, qdf, 6))] == want
    near = [df for label, df in emitted if label == "near"]
    assert len(near) == 1 and near[0].count() <= len(asked) * 6 * 4


def test_query_blocks_change_nothing(spark, monkeypatch):
    made, asked = library(spark)
    cdf, qdf = as_frames(spark, made, asked)
    index = scratch_index(cdf, "blocks")
    view = lambda df: [(r.query_id, r.rank, r.doc_id, r.seq, r.matched) for r in rows(df)]
    whole = view(keyword_search(index, qdf, 5))
    monkeypatch.setattr(blocks, "BLOCK_QUERIES", 4)
    cut = blocks.query_blocks
    monkeypatch.setattr(blocks, "query_blocks", lambda q: cut(q, 500, 4))
    assert view(keyword_search(index, qdf, 5)) == whole


def test_shuffled_joins_give_the_same(spark):
    """Beyond the broadcast bound every join still works as a shuffle."""
    made, asked = library(spark)
    cdf, qdf = as_frames(spark, made, asked)
    index = scratch_index(cdf, "smj")
    view = lambda df: [(r.query_id, r.rank, r.doc_id, r.seq, r.matched) for r in rows(df)]
    small = view(keyword_search(index, qdf, 5))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert view(keyword_search(index, qdf, 5)) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_rare_term_reads_its_folder_and_no_texts(spark, monkeypatch):
    made, asked = library(spark)
    made = [*made, ("rare", 0, "w1 zirconium"), ("rare", 1, "w2 Zirconium oxide")]
    asked = [(1, "zirconium oxide")]
    cdf, qdf = as_frames(spark, made, asked)
    monkeypatch.setattr(ix, "LEAST_PARTS", 32)
    index = scratch_index(cdf, "plan")
    everything = len(index.postings.inputFiles())
    read, plans, inner = [], [], blocks.written

    def spied(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return inner(df, label)

    def postings(*args):
        read.append(inner_postings(*args))
        return read[-1]

    inner_postings = keyword.term_postings
    monkeypatch.setattr(blocks, "written", spied)
    monkeypatch.setattr(keyword, "term_postings", postings)
    got = [((r.doc_id, r.seq), round(r.raw, 6)) for r in rows(keyword_search(index, qdf, 7))]
    assert got == brute_bm25(spark, made, asked, 7)[1] and len(got) == 2
    scan = read[0]._jdf.queryExecution().executedPlan()
    assert index.parts == 32 and everything >= 32
    assert "PartitionFilters: [part" in scan.toString() and "PushedFilters: [In(term" in scan.toString()
    read[0].collect()
    files = scan_files(read[0])
    assert 1 <= files <= 2 + 2 * everything / 32  # two terms, two folders
    assert plans and all("content" not in p and "doc_id" not in p for p in plans)


def scan_files(df):
    """Files that the scan of a plan opened."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numFiles").value()


def test_texts_are_looked_up_by_block(spark, monkeypatch):
    made, _ = library(spark, 400)
    cdf, _ = as_frames(spark, made, [])
    monkeypatch.setattr(ix, "BLOCK", 16)
    index = scratch_index(cdf.coalesce(1), "lookup")
    key = index.corpus.orderBy("chunk_no").select("chunk_no").limit(1)
    few = keyword.chunks_of(index, key)
    assert few.count() == 1 and "PushedFilters: [In(block" in few._jdf.queryExecution().executedPlan().toString().replace("IsNotNull(block), ", "").replace("EqualTo(block", "In(block")
    monkeypatch.setattr(keyword, "LISTED", 0)
    assert keyword.chunks_of(index, key).collect() == few.collect()


def test_small_holds_and_many_terms_change_nothing(spark, monkeypatch):
    made, asked = library(spark)
    made += [("tie", i, made[5][2]) for i in range(40)]
    want = brute_bm25(spark, made, asked, 3)
    cdf, qdf = as_frames(spark, made, asked)
    monkeypatch.setattr(ix, "BLOCK", 16)
    index = scratch_index(cdf, "small")
    monkeypatch.setattr(keyword, "HELD_HITS", 5)
    monkeypatch.setattr(keyword, "LISTED", 2)
    got = {q: [] for q, _ in asked}
    for r in rows(keyword_search(index, qdf, 3)):
        got[r.query_id].append(((r.doc_id, r.seq), round(r.raw, 6)))
    assert got == want


def test_scope(spark, index):
    asked = spark.createDataFrame(
        [("a", "固化剂 粘度 混合", False, None, None), ("b", "固化剂 粘度 混合", False, "c-d1", None), ("c", "固化剂 粘度 混合", True, None, None), ("d", "固化剂 粘度 混合", False, None, ["d2", "x"])],
        "query_id string, text string, only_pinned boolean, scope_category string, scope_tags array<string>",
    )
    library_docs = docs(spark, ["d2"])
    hits = rows(keyword_search(index, asked, 10, Scope(asked, library_docs)))
    seen = {q: {h.doc_id for h in hits if h.query_id == q} for q in "abcd"}
    assert seen == {"a": {"d1", "d2"}, "b": {"d1"}, "c": {"d2"}, "d": {"d2"}}
    signed = signatures(library_docs.unionByName(library_docs.filter("doc_id = 'd2'").withColumn("doc_id", F.lit("d3"))))
    met = {(r.query_id, "c-d1" in r.signature, r.n) for r in resolve_scope(asked, signed).collect()}
    assert met == {("b", True, 1), ("c", False, 2), ("d", False, 2)}
    counts = spark.createDataFrame([("d1", 3), ("d2", 2)], "doc_id string, n bigint")
    assert {tuple(r) for r in scoped_counts(asked, library_docs, counts).collect()} == {("a", 5), ("b", 3), ("c", 2), ("d", 2)}


def test_repeated_keys_are_indexed_once(spark, tmp_path):
    made = spark.createDataFrame([("a", 0, "first text", None), ("a", 0, "first text", None), ("b", 0, "", None)], "doc_id string, seq int, content string, page_no int")
    index = build_index(made, str(tmp_path / "i"), unique_keys=False)
    assert (index.n, index.avgdl) == (2, 1.5)


def test_fusion_merges_the_same_hit(spark):
    text = "x" * 80
    lists = [
        ("q", "case", 1, 2.5, 1, "case:c", 0, "c"),
        ("q", "keyword", 2, 1.0, 1, "d", 0, text + "one"),
        ("q", "keyword", 2, 1.0, 2, "d", 1, text + "two"),
        ("q", "semantic", 3, 1.0, 1, "d", 1, text + "two"),
        ("q", "semantic", 3, 1.0, 2, "e", 0, "e"),
    ]
    df = spark.createDataFrame(lists, "query_id string, list string, list_no int, weight double, rank int, doc_id string, seq int, content string")
    df = df.withColumn("page_no", F.lit(None).cast("int"))
    apart = fuse(df).orderBy("place").collect()
    assert [(r.doc_id, r.seq, r.sources) for r in apart] == [
        ("case:c", 0, ["case"]), ("d", 1, ["keyword", "semantic"]), ("d", 0, ["keyword"]), ("e", 0, ["semantic"])
    ]
    got = fuse(df, key_chars=80).orderBy("place").collect()
    assert [(r.doc_id, r.seq, r.sources) for r in got] == [("d", 0, ["keyword", "semantic"]), ("case:c", 0, ["case"]), ("e", 0, ["semantic"])]
    assert got[0].score == 1.0 and math.isclose(got[0].rrf, 2 / 61 + 1 / 62)


def test_cosine(spark):
    pairs = [([1.0, 0.0], [2.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [-1.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0, 0.0, 5.0], [1.0, 0.0], 1.0)]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>, want double")
    assert all(math.isclose(r.got, r.want, abs_tol=1e-12) for r in df.select(cosine(df.a, df.b).alias("got"), "want").collect())


def test_semantic_equals_brute_force(spark):
    rng = random.Random(5)
    vecs = [(f"d{i}", 0, [float(rng.randint(-2, 2)) for _ in range(rng.choice([3, 3, 4]))]) for i in range(300)]
    vdf = spark.createDataFrame(vecs, "doc_id string, seq int, vec array<float>")
    chunks = vdf.select("doc_id", "seq", F.lit("t").alias("content"), F.lit(1).alias("page_no"))
    asked = [(i, "t", [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(9)]
    got = {i: [] for i, _, _ in asked}
    for r in rows(semantic_search(vector_rows(vdf.repartition(4), chunks), spark.createDataFrame(asked, "query_id int, text string, query_vec array<float>"), 6)):
        got[r.query_id].append(r.doc_id)

    def cos(a, b):
        na, nb = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
        return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0

    for i, _, q in asked:
        best = sorted((-round(cos(q, v), 9), d) for d, _, v in vecs if len(v) == 3 and cos(q, v) > 1e-12)
        assert got[i] == [d for _, d in best[:6]]


def test_embedding_run(spark, chunks):
    blank_too = chunks.unionByName(chunks.limit(1).withColumns({"doc_id": F.lit("blank"), "content": F.lit(" 　")}))

    def lengths():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    made = embed_corpus(blank_too, lengths, "m")
    assert [tuple(r) for r in embedding_stats(made).collect()] == [("m", 2, 5)]

    def uneven():
        return lambda texts: [[1.0] * (i % 2 + 1) for i, _ in enumerate(texts)]

    with pytest.raises(Exception, match="sizes differ"):
        embed_corpus(chunks.coalesce(1), uneven, "m").collect()

    def by_task():
        from pyspark import TaskContext

        return lambda texts: [[1.0] * (TaskContext.get().partitionId() % 2 + 1) for _ in texts]

    with pytest.raises(ValueError, match="sizes differ"):
        embed_corpus(chunks.repartition(4, "seq"), by_task, "m")


def test_search_all(spark, chunks, index):
    library_docs = docs(spark).withColumns({"type": F.lit("pdf"), "created_at": F.current_timestamp()})
    asked = spark.createDataFrame([("q", "HY1578")], "query_id string, text string")
    found = rows(search_all(library_docs, library_docs, asked, keyword_search(index, asked, 30)))
    assert [(r.kind, r.doc_id) for r in found] == [("doc", "d2"), ("chunk", "d2")]
    assert found[0].snippet == "PDF 文档" and math.isclose(found[0].score, 3.2)


def test_context_budget(spark):
    def hits(*sizes):
        made = [("q", i + 1, "doc", None, "n", None, False, "x" * s) for i, s in enumerate(sizes)]
        return spark.createDataFrame(made, "query_id string, rank int, kind string, outcome string, doc_name string, page_no int, pinned boolean, content string")

    asked = ask(spark, "x")
    assert cx.build_context(hits(5), asked).first().context == "[来源1] 《n》\nxxxxx"
    cut = cx.build_context(hits(7000, 7000, 10), asked).first()
    assert cut.context.startswith("（上下文已达长度上限，后面 2 段未纳入本次回答）\n\n[来源1]") and (cut.n_used, cut.n_cut) == (1, 2)
    long = cx.build_context(hits(20000), asked).first()
    assert long.context.endswith("x…（本段已截断）") and long.n_used == 1
    assert cx.build_context(hits().filter("false"), asked).first().context == "（资料库暂无相关内容）"


def test_citations(spark):
    answers = spark.createDataFrame([("m", "见[来源 1]和[来源3]。")], "msg_id string, text string")
    quoted = spark.createDataFrame([("m", 1, "CY1578.pdf")], "msg_id string, n int, doc_name string")
    assert cx.rendered_answers(answers, quoted).first().text == "见CY1578和来源3。"
    assert [(r.n, r.label) for r in cx.citations(answers, quoted).orderBy("at").collect()] == [(1, "CY1578"), (3, "来源3")]
    wild = spark.createDataFrame([("w", "[来源99999999999]和[来源1]")], "msg_id string, text string")
    twice = spark.createDataFrame([("w", 1, "B.pdf"), ("w", 1, "A.pdf")], "msg_id string, n int, doc_name string")
    assert cx.rendered_answers(wild, twice).first().text == "来源99999999999和A"
    assert [(r.n, r.label) for r in cx.citations(wild, twice).orderBy("at").collect()] == [(None, "来源99999999999"), (1, "A")]
