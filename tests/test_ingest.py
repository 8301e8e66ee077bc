import random

from pyspark.sql import functions as F

from folioseek.functions.classify import classify
from folioseek.functions.text import fingerprint
from folioseek.operators.library import chunk_labels, reclassified, stale_categories
from folioseek.plans.ingest import first_copies, import_files, sync_files
from folioseek.sources.files import MAX_BYTES, file_type, read_files, routed
from folioseek.streaming.sync import add_batch, finished, sync_folder, synced


def extractor():
    def extract(content, name):
        if content.startswith(b"scan"):
            return "", 1, None
        return content.decode("utf-8"), (2 if name.lower().endswith(".pdf") else None), None

    return extract


def write_files(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / name.replace("__", ".")).write_bytes(content)


def parsed(spark, folder, **options):
    files = routed(read_files(spark, str(folder)), extractor, **options)
    return files.withColumns({"doc_id": F.col("name"), "created_at": F.col("modificationTime")})


BODY = ("CY1578 技术数据表 混合粘度。" * 40).encode()


def test_routes(spark, tmp_path):
    write_files(tmp_path / "in", a__txt=b"\xef\xbb\xbf  hello \n", b__PDF=BODY, c__pdf=b"scan", d__doc=b"x", e__docx="正文内容足够长的一段文字".encode(), f__log=b"odd", g__md=b" ", h__pdf="⽤⼯".encode() * 30)
    rows = {r.name: r for r in parsed(spark, tmp_path / "in").collect()}
    assert (rows["a.txt"].text, rows["a.txt"].quality, rows["a.txt"].source, rows["a.txt"].type) == ("hello", 1.0, "local", "txt")
    assert rows["b.PDF"].pages == 2 and rows["b.PDF"].type == "pdf" and rows["b.PDF"].source == "local"
    assert rows["c.pdf"].text is None and rows["c.pdf"].source == "none" and "扫描件" in rows["c.pdf"].note
    assert rows["d.doc"].text is None and rows["d.doc"].note.startswith("老式 .doc") and rows["d.doc"].type == "word"
    assert rows["e.docx"].quality == 1.0 and rows["e.docx"].pages is None
    assert (rows["f.log"].text, rows["f.log"].quality, rows["f.log"].type) == ("odd", 0.5, "txt")
    assert rows["g.md"].text is None and rows["g.md"].quality == 0.0
    assert rows["h.pdf"].text == "用工" * 30
    served = {r.name: r for r in parsed(spark, tmp_path / "in", by_service=True).collect()}
    assert served["b.PDF"].source == "nas" and served["b.PDF"].quality >= 0.88


def test_size_limit_is_an_argument(spark):
    files = spark.createDataFrame([("big.pdf", 49 * 1024 * 1024, bytearray(b"x"))], "name string, size bigint, content binary")
    assert routed(files.withColumn("content", F.lit(BODY)), extractor).first().text is not None
    row = routed(files, extractor, max_bytes=MAX_BYTES).first()
    assert row.text is None and row.note == "文件过大（49.0 MB），为避免手机内存不足已跳过解析。"


def test_types(spark):
    names = spark.createDataFrame([(n,) for n in ("a.PDF", "b.doc", "c.docx", "d.markdown", "e", "f.tar.gz")], "n string")
    assert [r.t for r in names.select(file_type(F.col("n")).alias("t")).collect()] == ["pdf", "word", "word", "md", "txt", "txt"]


def test_import_pass(spark, tmp_path):
    write_files(tmp_path / "in", a__txt=BODY, b__txt=BODY, c__pdf=b"scan", d__pdf=b"scan", e__md="另一份\n资料".encode())
    done = import_files(parsed(spark, tmp_path / "in"), None, [F.col("name")], "拉挤")
    docs = {r.doc_id: r for r in done.documents.collect()}
    assert set(docs) == {"a.txt", "c.pdf", "d.pdf", "e.md"}
    assert (docs["a.txt"].model, docs["a.txt"].kind, docs["a.txt"].status, docs["a.txt"].category) == ("CY1578", "tds", "indexed", "拉挤")
    assert docs["c.pdf"].status == "partial" and docs["c.pdf"].hash is None
    assert {r.doc_id for r in done.chunks.collect()} == {"a.txt", "e.md"}
    assert done.counts.first().asDict() == {"added": 4, "skipped": 1, "failed": 2}
    assert {r.reason for r in done.failures.collect()} == {"c.pdf：未检测到文本层，可能是扫描件（需要 OCR）", "d.pdf：未检测到文本层，可能是扫描件（需要 OCR）"}
    again = sync_files(parsed(spark, tmp_path / "in"), done.documents, [F.col("name")])
    assert again.counts.first().asDict() == {"added": 0, "skipped": 3, "unreadable": 2}
    assert {r.name for r in again.failures.collect()} == {"c.pdf", "d.pdf"}
    fresh = sync_files(parsed(spark, tmp_path / "in"), None, [F.col("name")])
    assert all(r.tags == ["NAS"] and r.source == "nas" for r in fresh.documents.collect())


def test_one_content_in_most_files(spark):
    rows = [(f"f{i:03d}", "same" if i % 3 else (None if i % 2 else f"h{i}"), i) for i in range(90)]
    files = spark.createDataFrame(rows, "doc_id string, hash string, at int").repartition(6)
    kept = {r.doc_id for r in first_copies(files, None, [F.col("at")]).filter("is_new").collect()}
    assert kept == {d for d, h, _ in rows if h != "same"} | {"f001"}


def test_reclassify_modes(spark):
    docs = spark.createDataFrame([("a", "x.pdf", "OLD1", None), ("b", "CY1578.pdf", None, "spec")], "doc_id string, name string, model string, kind string")
    chunks = spark.createDataFrame([("a", 0, "HY5192 COA"), ("a", 1, "HY5192"), ("a", 2, "z" * 4000), ("a", 3, "CY999 CY999 CY999")], "doc_id string, seq int, content string")
    view = lambda df: {r.doc_id: (r.model, r.kind) for r in df.collect()}
    assert view(reclassified(docs, chunks)) == {"a": ("CY999", "report"), "b": ("CY1578", "spec")}
    assert view(reclassified(docs, chunks, scan_chars=3000)) == {"a": ("HY5192", "report"), "b": ("CY1578", "spec")}
    assert view(reclassified(docs, chunks, fill_only=True)) == {"a": ("OLD1", "report"), "b": ("CY1578", "spec")}
    listed = spark.createDataFrame([("A",)], "category string")
    stale = docs.withColumn("category", F.when(F.col("doc_id") == "a", "B").otherwise("A"))
    assert [r.doc_id for r in stale_categories(stale, listed).collect()] == ["a"]


def test_labels_of_chunks_are_those_of_the_joined_text(spark):
    rnd = random.Random(11)
    words = "AB CDE AB123 CDE1234 123 1234 123F 12345 ISO X x Technical Data Sheet Product Safety Certificate of Analysis Spec TDS".split()
    gaps = ["", "", " ", "-", "  ", "\n", "\u3000", " " * 60]

    def part(some):
        text = "".join(rnd.choice(some) + rnd.choice(gaps) for _ in range(rnd.randint(1, 4)))
        return rnd.choice(["", "", " "]) + text + rnd.choice(["", "", "y" * 50])

    picked = [rnd.sample(words, 4) for _ in range(1500)]  # few words a document, so that hits repeat
    texts = {f"d{i}": [part(some) for _ in range(rnd.randint(1, 7))] for i, some in enumerate(picked)}
    rows = [(d, seq, text) for d, parts in texts.items() for seq, text in enumerate(parts)]
    chunks = spark.createDataFrame(rows, "doc_id string, seq int, content string").repartition(5)
    whole = spark.createDataFrame([(d, "\n".join(parts)) for d, parts in texts.items()], "doc_id string, text string")
    for scan in (None, 25):
        model, kind = classify(F.lit(""), F.col("text"), scan)
        expected = {tuple(r) for r in whole.select("doc_id", model, kind).collect()}
        assert {tuple(r) for r in chunk_labels(chunks, scan).collect()} == expected
        model, kind = classify(F.lit(""), F.regexp_replace("text", "\n", "|"), scan)
        assert {tuple(r) for r in whole.select("doc_id", model, kind).collect()} != expected  # line breaks decide some
    assert chunk_labels(chunks.limit(0)).count() == 0


def test_labels_do_not_gather_the_texts_of_a_document(spark, tmp_path):
    path = f"{tmp_path}/chunks"
    spark.createDataFrame([("a", 0, "AB 123")], "doc_id string, seq int, content string").write.parquet(path)
    plan = chunk_labels(spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "content" not in plan


def test_texts_that_differ_in_the_middle_are_different(spark):
    side = "x" * 60_000
    rows = [(name, side + middle * 20_000 + side, at) for name, middle, at in (("a", "m", 1), ("b", "n", 2), ("c", "m", 3))]
    files = spark.createDataFrame(rows, "doc_id string, text string, at int")
    hashed = files.withColumn("hash", fingerprint(F.col("text")))
    assert {r.doc_id for r in first_copies(hashed, None, [F.col("at")]).filter("is_new").collect()} == {"a", "b"}
    sampled = files.withColumn("hash", fingerprint(F.col("text"), 60_000))
    assert {r.doc_id for r in first_copies(sampled, None, [F.col("at")]).filter("is_new").collect()} == {"a"}


def names_in(spark, table):
    return sorted(r.name for r in synced(spark, table, "documents").collect())


def test_stream_sync(spark, tmp_path):
    folder, table, mark = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "mark")
    sync = lambda m: sync_folder(spark, str(folder), table, m, make_extractor=extractor).awaitTermination()
    write_files(folder, a__txt=BODY, b__txt=b"second text", c__md=b" ")
    sync(mark)
    assert names_in(spark, table) == ["a.txt", "b.txt"]
    assert [r.unreadable for r in finished(spark, table).collect()] == [1]
    assert [r.name for r in synced(spark, table, "unreadable").collect()] == ["c.md"]
    sync(mark)
    write_files(folder, d__txt=BODY, e__txt=b"third text")
    sync(mark)
    assert names_in(spark, table) == ["a.txt", "b.txt", "e.txt"]
    sync(str(tmp_path / "other"))  # a lost checkpoint reads all files again and adds nothing
    assert names_in(spark, table) == ["a.txt", "b.txt", "e.txt"]
    assert spark.read.parquet(f"{table}/documents").count() == 3
    chunked = {r.doc_id for r in synced(spark, table, "chunks").collect()}
    assert chunked == {r.doc_id for r in synced(spark, table, "documents").collect()}


def test_two_folders_in_one_table(spark, tmp_path):
    table = str(tmp_path / "table")
    for turn in range(2):
        for name in ("one", "two"):
            write_files(tmp_path / name, **{f"{name}{i}__txt": f"text {name} {i}".encode() for i in range(3)})
            checkpoint = str(tmp_path / f"mark-{name}")
            sync_folder(spark, str(tmp_path / name), table, checkpoint, make_extractor=extractor).awaitTermination()
        assert names_in(spark, table) == [f"{n}{i}.txt" for n in ("one", "two") for i in range(3)]
        assert spark.read.parquet(f"{table}/documents").count() == 6


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    write_files(tmp_path / "in", a__txt=BODY, b__txt=b"second text")
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    table = str(tmp_path / "table")
    for _ in range(2):
        add_batch(files, 7, table, "sync", extractor)
        assert names_in(spark, table) == ["a.txt", "b.txt"]
    add_batch(files.limit(0), 7, table, "sync", extractor)
    assert names_in(spark, table) == []
    add_batch(files, 7, table, "another", extractor)
    assert names_in(spark, table) == ["a.txt", "b.txt"]
