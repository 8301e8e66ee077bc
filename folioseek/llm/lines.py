"""Operator 1: quality rules with cross-document line frequency.

Lines are normalised (A-Z as a-z, digits as 0, white space as one space, trimmed) and hashed to 64 bits. A line is
counted once per distinct text of a host, so copies of one document do not make its lines frequent.
A line is frequent where it stands in more than `max_docs` distinct texts of the host, however many the host
has; `max_share` above 0 asks for that share of them too. Frequent lines are removed; a document that keeps less than `min_left` of its
words is depleted and rejected. Documents that fail the base rules (too few words, too many words in
repeated 8-word windows) are rejected before that, but still count.

Words are runs without ASCII white space. Null and empty texts have no words and so fail the base rules. A null
host is a host of its own. Very long texts are read whole, one at a time. Rows are judged one by one, so repeated rows get equal verdicts; empty
tables give empty results.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import Scratch, arrow_schema, text_slices

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: White space and the bytes that continue a UTF-8 character: what is left counts code points of words.
NOT_COUNTED = b" \t\n\r\x0b\f" + bytes(range(0x80, 0xC0))
DIGITS = bytes.maketrans(b"123456789", b"000000000")

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().translate(DIGITS).split())


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows that stand twice or more in the text."""
    if len(words) <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    with np.errstate(over="ignore"):
        for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
            h = h[:-step] * np.uint64(factor) + h[step:]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice)).tolist()
    windows = [tuple(words[i : i + WINDOW]) for i in at]  # the words themselves decide
    counts = Counter(windows)
    cover = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, windows):
        if counts[w] > 1:
            cover[i] += 1
            cover[i + WINDOW] -= 1
    return int((np.cumsum(cover) > 0).sum())


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, NOT_COUNTED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)


def _scanned(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """Per row: statistics, a 128-bit digest of the text, and the hash and words of each line that has words."""
    ddl = f"row long, key {docs.schema[key].dataType.simpleString()}, host string, {STATS}, digest binary, hashes array<long>, line_words array<int>"
    schema = arrow_schema(ddl)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        F.col(host).cast("string").alias("host"),
        F.col(text).cast("binary").alias("text"),
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            stats, digests, hashes, sizes = [], [], [], []
            for t in texts:
                t = t or b""
                stats.append(text_stats(t))
                digests.append(xxhash.xxh3_128_digest(t))
                h, n = [], []
                for line in t.split(b"\n"):
                    words = len(line.split())
                    if words:
                        x = xxhash.xxh3_64_intdigest(normal_line(line))
                        h.append(x - (1 << 64) if x >> 63 else x), n.append(words)
                hashes.append(h), sizes.append(n)
            new = [pa.array(c, pa.int64()) for c in zip(*stats)]
            new += [pa.array(digests, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
            columns = [batch.column(i) for i in range(3)] + new
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(task, ddl)


def frequent_lines(scanned: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """(host, hash) of the frequent lines."""
    # a text's lines are a function of the text: any of its copies stands for it
    texts = scanned.groupBy("host", "digest").agg(F.first("hashes").alias("hashes"))
    sizes = texts.groupBy("host").agg(F.count("*").alias("n_texts"))
    lines = texts.select("host", F.explode(F.array_distinct("hashes")).alias("hash"))
    counts = lines.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
    same_host = counts["host"].eqNullSafe(sizes["host"])
    return counts.join(sizes, same_host).where(F.col("n") > F.col("n_texts") * max_share).select(counts["host"], "hash")


def line_report(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_docs: int = 10,
    max_share: float = 0.0,
    min_left: float = 0.5,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """Per row of `docs`: `key`, the base statistics, base_failed, n_removed_words, removed (hashes), kept."""
    scratch = Scratch(docs.sparkSession, "lines")
    scanned = scratch.table(_scanned(docs, key, text, host), "scanned", lasting=True)
    frequent = scratch.table(frequent_lines(scanned, max_docs, max_share), "frequent", lasting=True)
    lines = scanned.select("row", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"),
                           F.explode(F.arrays_zip(F.col("hashes").alias("hash"), F.col("line_words").alias("words"))).alias("line"))
    lines = lines.select("row", "host", "no_host", F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    limits = frequent.select(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), "hash")
    removed = lines.join(limits, ["host", "no_host", "hash"], "left_semi")
    per_row = removed.groupBy("row").agg(F.sum("words").alias("n_removed_words"), F.collect_set("hash").alias("removed"))
    out = scanned.drop("hashes", "line_words", "digest").join(per_row, "row", "left")
    gone = F.coalesce(F.col("n_removed_words"), F.lit(0))
    depleted = F.col("n_words") - gone < F.col("n_words") * min_left
    failed = base_failed(min_words, max_repeat_percent)
    return out.select(
        F.col("key").alias(key), *(s.split()[0] for s in STATS.split(", ")), failed.alias("base_failed"),
        gone.alias("n_removed_words"), F.coalesce("removed", F.array().cast("array<long>")).alias("removed"),
        (~failed & ~depleted).alias("kept"),
    )


def remove_frequent_lines(docs: DataFrame, report: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept documents (unique `key`) without their frequent lines; columns as in `docs`."""
    verdicts = report.where("kept").select(F.col(key).alias("__key__"), F.col("removed").alias("__removed__"))
    joined = docs.join(verdicts, F.col(key).eqNullSafe(F.col("__key__"))).drop("__key__")
    schema = joined.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    arrow = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text):
            new = []
            for t, gone in zip(texts, batch.column(batch.schema.get_field_index("__removed__")).to_pylist()):
                if t is not None and gone:
                    gone = {x & (1 << 64) - 1 for x in gone}
                    lines = t.split(b"\n")
                    t = b"\n".join(x for x in lines if not x.strip() or xxhash.xxh3_64_intdigest(normal_line(x)) not in gone)
                new.append(t)
            have = {n: batch.column(batch.schema.get_field_index(n)) for n in arrow.names}
            have[text] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([have[n].cast(f.type) for n, f in zip(arrow.names, arrow)], schema=arrow)

    assert set(schema.names) == {*docs.columns, "__removed__"}
    return joined.mapInArrow(task, ddl)
