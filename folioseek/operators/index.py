"""Keyword index as ordinary tables, built once and queried many times.

corpus     chunk_no, block, at, doc_id, seq, page_no, content, tokens, dl   one row per chunk or case, in the order of equal scores
postings   part, term, block, at, tf, dl, most                             one row per term and block of BLOCK chunks (two where a task's end cut the block)
terms      term, df                                                        vocabulary, sorted by term
size       n, avgdl, tokens, parts                                         numbers about the whole corpus

Postings lie in folders by hash of the term (`part`) and in the order of terms, so a search reads the folders of its
terms only, and in them the row groups that can hold a term. A folder has slices by hash of block and term, so a term that most chunks have
is in many files and no task writes more than a bounded number of tokens. A row
has all that a score needs: places in the block, counts, lengths, and `most`, the largest BM25 factor in it. Documents come before
cases and then by id and position, so `chunk_no` alone decides between equal scores.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import is_case
from ..functions.text import index_tokens
from .tables import first_seen, scratch, scratch_path, written

# --- fixed values ---
K1 = 1.2  # term frequency saturation
B = 0.75  # length normalisation
# --- end of fixed values ---

BLOCK = 256  # chunks whose places are counted together; a power of 2
PART_TOKENS = 20_000_000  # of the corpus per folder of postings, between the two bounds
LEAST_PARTS, MOST_PARTS = 8, 4096
SLICE_TOKENS = 2_500_000  # of the corpus per file of postings
LEAST_SLICES = 2
COUNT_TOKENS = 2_000_000  # that a task counts together
FIRST_CASE = 1 << 52  # cases are numbered from here, after all documents
HELD_TOKENS = 100_000  # kinds of the rows of one key that a task puts together
CORPUS = "chunk_no bigint, block bigint, at int, doc_id string, seq int, page_no int, content string, tokens array<string>, dl int"
POSTINGS = "term string, block bigint, at array<int>, tf array<int>, dl array<int>, most double, part int"
TERMS = "term string, df bigint"


def idf(df: Column, n: float) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_part(tf, dl, avgdl: float):
    """The BM25 factor that depends on the chunk, for columns or arrays; times idf it is the contribution."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


@dataclass
class KeywordIndex:
    corpus: DataFrame
    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    parts: int


def build_index(rows: DataFrame, path: str, unique_keys: bool = True) -> KeywordIndex:
    """Index (doc_id, seq, content, page_no) under `path`.

    The rows are made once and kept while the corpus is written, as cutting ranges reads them before. The corpus is tokenised
    once; the later writes read only the columns they need of the one before. `chunk_no` is fixed by the corpus write, and everything else derives from the written corpus.
    """
    spark = rows.sparkSession
    rows = rows.select("doc_id", F.col("seq").cast("int").alias("seq"), "page_no", "content")
    if not unique_keys:
        rows = first_seen(rows, ["doc_id", "seq"], [F.col("content")])
    with scratch(spark):
        _write_corpus(written(rows, "rows", compression="zstd"), path)
    corpus = spark.read.schema(CORPUS).parquet(f"{path}/corpus")

    tokens = F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")
    parts = F.least(F.greatest(F.ceil(F.col("tokens") / PART_TOKENS), F.lit(LEAST_PARTS)), F.lit(MOST_PARTS)).cast("int")
    totals = corpus.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"), tokens)
    totals.withColumn("parts", parts).write.mode("overwrite").parquet(f"{path}/size")
    size = spark.read.parquet(f"{path}/size").first()

    # The corpus lies in the order of its numbers, so the task that reads it counts each block alone, and the one shuffle is
    # that of counted rows, packed by column. Each folder is cut into slices by hash of block and term: a frequent term is in all of them.
    n = size["parts"]
    slices = max(LEAST_SLICES, math.ceil(size["tokens"] / n / SLICE_TOKENS), math.ceil(spark.sparkContext.defaultParallelism / n))
    slice_of = F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice")
    packed = corpus.select("block", "at", "dl", "tokens", slice_of).mapInArrow(_counted(n, slices), "place int, uses binary")
    rows = packed.repartitionById(n * slices, F.col("place")).mapInArrow(_unpacked(slices, size["avgdl"]), POSTINGS)
    rows = rows.sortWithinPartitions("part", "term", "block")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{path}/postings")
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    (
        postings.groupBy("term")
        .agg(F.sum(F.size("at")).alias("df"))
        .sortWithinPartitions("term")
        .write.mode("overwrite")
        .parquet(f"{path}/terms")
    )
    return open_index(spark, path)


def _write_corpus(rows: DataFrame, path: str) -> None:
    body, order = F.coalesce("content", F.lit("")), [F.col("doc_id"), F.col("seq")]
    # Cases are whole texts, far longer than chunks: both are cut into ranges of their own, so that no range holds most of the bytes.
    for first, kind in ((0, ~is_case(F.col("doc_id"))), (FIRST_CASE, is_case(F.col("doc_id")))):
        ranges = rows.filter(kind).repartitionByRange(*order).sortWithinPartitions(*order)
        corpus = ranges.select((F.monotonically_increasing_id() + first).alias("chunk_no"), "*", index_tokens(body).alias("tokens"))
        corpus = corpus.withColumns(
            {
                "dl": F.greatest(F.size("tokens"), F.lit(1)),
                "block": F.floor(F.col("chunk_no") / BLOCK),
                "at": (F.col("chunk_no") % BLOCK).cast("int"),
            }
        )
        names = [c.split()[0] for c in CORPUS.split(", ")]
        corpus.select(*names).write.mode("append" if first else "overwrite").option("compression", "zstd").parquet(f"{path}/corpus")


def _counted(parts: int, slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the corpus in its order -> counted blocks, packed by folder and slice. Only the ends of a task cut a block."""

    def count(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        block, at, dl, part = (rows[c].to_numpy() for c in ("block", "at", "dl", "slice"))
        lists = rows["tokens"].combine_chunks()
        words = pc.list_flatten(lists).dictionary_encode()
        if not len(words):
            return
        hashes = np.array([xxhash.xxh64_intdigest(w, seed=42) for w in words.dictionary.to_pylist()], "uint64").astype("int64")  # as in part_of
        use, tf = np.unique(np.asarray(words.indices).astype("int64") * len(block) + np.asarray(pc.list_parent_indices(lists)), return_counts=True)
        word, row = np.divmod(use, len(block))
        start = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (block[row[1:]] != block[row[:-1]]))))
        n, word = np.diff(np.append(start, len(use))), word[start]
        place = hashes[word] % parts * slices + (hashes[word] // parts + part[row[start]]) % slices
        order = np.argsort(place, kind="stable")
        for g in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            uses = np.repeat(start[g] - np.cumsum(n[g]) + n[g], n[g]) + np.arange(n[g].sum())
            first = np.flatnonzero(np.concatenate(([True], np.diff(word[g]) != 0)))
            columns = {"term": words.dictionary.take(pa.array(word[g][first])), "block": block[row[start[g]]], "n": n[g], "at": at[row[uses]], "tf": tf[uses], "dl": dl[row[uses]], "times": np.diff(np.append(first, len(g)))}
            held = pa.table({c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if c == "term" else pa.array(v)) for c, v in columns.items()})
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(held)
            yield pa.RecordBatch.from_arrays([pa.array([place[g[0]]], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["place", "uses"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for batch in batches:
            held.append(batch)
            tokens += len(pc.list_flatten(batch.column("tokens")))
            if tokens >= COUNT_TOKENS:
                rows = pa.Table.from_batches(held)
                block = rows["block"].to_numpy()
                last = int(np.flatnonzero(block != block[-1])[-1]) + 1 if (block != block[-1]).any() else 0
                yield from count(rows.slice(0, last))
                held = rows.slice(last).to_batches()
                tokens = sum(len(pc.list_flatten(b.column("tokens"))) for b in held)
        if held:
            yield from count(pa.Table.from_batches(held))

    return run


def _unpacked(slices: int, avgdl: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed blocks -> postings, one row per term and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, uses in zip(batch.column("place").to_pylist(), batch.column("uses")):
                held = pa.ipc.open_stream(uses.as_buffer()).read_all()
                column = {c: held[c].combine_chunks().flatten() for c in held.column_names}
                block, n, at, tf, dl, times = (column[c].to_numpy() for c in ("block", "n", "at", "tf", "dl", "times"))
                ends = np.append(0, np.cumsum(n))
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(v.astype("int32"))) for v in (at, tf, dl)]
                terms = column["term"].take(pa.array(np.repeat(np.arange(len(times)), times)))
                most = np.maximum.reduceat(term_part(tf, dl, avgdl), ends[:-1])
                columns = [terms, pa.array(block), *lists, pa.array(most), pa.array(np.full(len(n), place // slices, "int32"))]
                yield from pa.table(columns, names=[c.split()[0] for c in POSTINGS.split(", ")]).to_batches(max_chunksize=10_000)

    return run


def part_of(term: Column, parts: int) -> Column:
    """The folder of a term's postings."""
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def open_index(spark: SparkSession, path: str) -> KeywordIndex:
    size = spark.read.parquet(f"{path}/size").first()
    return KeywordIndex(
        corpus=spark.read.schema(CORPUS).parquet(f"{path}/corpus"),
        postings=spark.read.schema(POSTINGS).parquet(f"{path}/postings"),
        terms=spark.read.schema(TERMS).parquet(f"{path}/terms"),
        n=size["n"],
        avgdl=size["avgdl"],
        parts=size["parts"],
    )


def occurrences(index: KeywordIndex) -> DataFrame:
    """(term, chunk_no, tf): the postings one by one."""
    uses = index.postings.select("block", "term", F.explode(F.arrays_zip("at", "tf")).alias("u"))
    return uses.select("term", (F.col("block") * BLOCK + F.col("u.at")).alias("chunk_no"), F.col("u.tf").alias("tf"))


def scratch_index(rows: DataFrame, label: str, **options) -> KeywordIndex:
    """An index in the scratch folder, for one run."""
    return build_index(rows, scratch_path(rows.sparkSession, f"index-{label}"), **options)


def token_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, seq, n, kinds, chars, last): the tokens of all rows (doc_id, seq, content) of a key; keys without tokens are left out.

    A row is counted where it is made, so that only its figures are shuffled. Kinds cannot be added up: keys of several rows are
    counted again from their tokens, which meet as one list per row, or one by one for keys of more than HELD_TOKENS.
    """
    words, figures = F.col("tokens"), ["doc_id", "seq", "n", "kinds", "chars", "last"]
    cut = rows.select("doc_id", "seq", index_tokens(F.col("content")).alias("tokens"))
    counted = cut.groupBy("doc_id", "seq").agg(
        F.count_if(F.size(words) > 0).alias("rows"),
        F.sum(F.size(words)).alias("n"),
        F.sum(F.size(F.array_distinct(words))).alias("kinds"),
        F.sum(F.length(F.array_join(words, ""))).alias("chars"),
        F.max(F.array_max(words)).alias("last"),
    )
    counted = written(counted.filter("n > 0"), "tokens")
    again = written(counted.filter("rows > 1"), "tokens-again")
    if again.isEmpty():
        return counted.select(*figures)

    # The join by document stands on the rows themselves, so only the texts of these documents are cut once more.
    of_doc = F.col("doc_id").eqNullSafe(F.col("in_doc"))
    of_key, key = of_doc & F.col("seq").eqNullSafe(F.col("in_seq")), [F.col("doc_id").alias("in_doc"), F.col("seq").alias("in_seq")]
    docs = written(again.select(key[0]).distinct(), "tokens-docs")
    wide = written(again.filter(F.col("kinds") > HELD_TOKENS).select(*key, F.lit(True).alias("wide")), "tokens-wide")
    lists = rows.join(docs, of_doc, "left_semi").select("doc_id", "seq", index_tokens(F.col("content")).alias("tokens"))
    lists = lists.select("doc_id", "seq", F.sort_array(F.array_distinct(words)).alias("tokens")).join(wide, of_key, "left")
    parts = F.when(F.col("wide"), words).otherwise(F.array(F.array_join(words, " ")))  # no token has a blank
    parts = lists.select("doc_id", "seq", "wide", F.explode(parts).alias("part"))
    parts = parts.groupBy("doc_id", "seq", F.when(F.col("wide"), F.col("part")).alias("word"))
    kinds = parts.agg(F.size(F.array_distinct(F.split(F.array_join(F.collect_set("part"), " "), " "))).alias("kinds"))
    kinds = kinds.groupBy(*key).agg(F.sum("kinds").alias("kinds"))
    return counted.filter("rows = 1").select(*figures).unionByName(again.drop("kinds").join(kinds, of_key).select(*figures))


def corpus_fingerprint(rows: DataFrame) -> DataFrame:
    """`count:sum(length + 1)`; reported, but equal-length edits do not change it."""
    return rows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.length(F.coalesce("content", F.lit(""))) + 1), F.lit(0)).alias("chars"),
    ).withColumn("fingerprint", F.concat_ws(":", "n", "chars"))
