"""The index build: one shuffle of counted rows, cases in ranges of their own, blocks whole over batches and slices."""
from __future__ import annotations

from collections import Counter

from folioseek.operators import index as ix
from folioseek.operators.blocks import arrow_rows
from folioseek.operators.index import occurrences, scratch_index
from folioseek.operators.keyword import keyword_search

ROWS = "doc_id string, seq int, content string"


def library(spark, docs=90, cases=30):
    chunks = [(f"d{i:03}", 0, " ".join(f"w{j}" for j in range(i % 7)) + (" same same" if i % 2 else "")) for i in range(docs)]
    texts = [(f"case:{i:03}", 0, "same " + "long text " * 400 + f"w{i % 7}") for i in range(cases)]
    return spark.createDataFrame([*chunks, *texts, ("none", 0, None)], ROWS).withColumn("page_no", ix.F.lit(1))


def test_blocks_over_batches_and_slices(spark, monkeypatch):
    df = library(spark)
    asked = spark.createDataFrame([(1, "same w3 long"), (2, "w5")], "query_id int, text string")
    view = lambda index: [tuple(r) for r in keyword_search(index, asked, 9).select("query_id", "rank", "doc_id", ix.F.round("raw", 6)).orderBy("query_id", "rank").collect()]
    want = view(scratch_index(df, "plain"))
    monkeypatch.setattr(ix, "BLOCK", 16)
    monkeypatch.setattr(ix, "SLICE_TOKENS", 200)
    with arrow_rows(spark, 5):
        index = scratch_index(df.repartition(3), "sliced")
    got = Counter({(r.chunk_no, r.term): r.tf for r in occurrences(index).collect()})
    assert got == Counter((r.chunk_no, t) for r in index.corpus.collect() for t in r.tokens)
    assert index.postings.groupBy("term", "block").count().filter("count > 1").isEmpty()
    assert len(index.postings.filter("part = 0").inputFiles()) > 1 and view(index) == want


def test_cases_have_ranges_of_their_own(spark):
    """By rows alone, cases shared one range with chunks, and it held most of the bytes."""
    index = scratch_index(library(spark, 4000, 40), "ranges")
    kinds = index.corpus.select(ix.F.input_file_name().alias("f"), ix.is_case(ix.F.col("doc_id")).alias("c")).groupBy("f").agg(ix.F.count_distinct("c").alias("n"))
    assert kinds.agg(ix.F.max("n")).first()[0] == 1 and index.corpus.filter("chunk_no >= 4503599627370496").count() == 40


def test_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = library(spark)
    built = scratch_index(rows.mapInArrow(count, rows.schema), "once")
    assert made.value == built.n == 121
