"""Operator 11: SimHash near-duplicates by meet-in-the-middle ball hashing.

The fingerprint of a text has the bits that more than half of its 4-word shingles' hashes have (A-Z as a-z; words are runs without
ASCII white space; repeated shingles count as often as they stand; with fewer words, all of them are one shingle).
Fingerprints link when at most `radius` bits differ, an even number. Then, and only then, some *variant* has at most half
as many bits different from each of the two, so all fingerprints with a common variant are linked with each other. There
are no false candidates, a variant's group needs links to its least member only, and, as fingerprints are made
distinct first, no variant has more than ball_size(radius / 2) of them (2081 for radius 4) however often a text is copied.

Every fingerprint emits all its variants; but as 2081 rows of two numbers each would take more room than the texts do, they are sent as
sets. Fingerprints are dealt into blocks. A block sends the codes of its variants, sorted and packed (a code is
a hash of the variant, of just as many bits as make few unequal variants meet), one row per range of codes. Whoever
has a range finds the codes that occur more than once and sends them back to their blocks, which make their variants
again and send, now as rows (variant, fingerprint), those with such a code: 6 to some 130 per link, and few others. These meet
by the variant itself and are verified. Components come from links by joins.

Null and empty texts, and those without words, have fingerprint 0, which links like any other. Equal texts have one
fingerprint, whatever their number; ties of bits (exactly half) are 0. Very long texts are read whole, in parts of bounded size. Rows that
repeat a key are rows of their own; null keys are ignored as component ids while another key is in the component.
An empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import Scratch, arrow_schema, text_slices
from folioseek.llm.jaccard import components, mixed

SHINGLE, SEED, BITS = 4, 42, 64
BLOCK = 4096  # fingerprints of a block; their variants take 70 MB
RANGE = 1 << 23  # codes that meet in one range, about
SPARE_BITS = 7  # of a code beyond those that number all variants: one of 100 variants meets another by chance
PART = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(text: bytes | None) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, PART):
        spans = zip(starts[i : min(i + PART, n)].tolist(), ends[i + width - 1 : min(i + PART, n) + width - 1].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print as signed long) per row."""
    ddl = f"key {docs.schema[key].dataType.simpleString()}, print long"
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema[0].type), pa.array(prints)], schema=schema)

    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(task, ddl)


def ball(radius: int) -> np.ndarray:
    """All masks of at most `radius` bits."""
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)], np.uint64)


def ball_size(radius: int) -> int:
    return sum(math.comb(BITS, k) for k in range(radius + 1))


def packed(codes: np.ndarray, span: int) -> bytes:
    """Sorted codes from 0 to span - 1 (repeats too): low bits as they are, high bits as steps in unary. About 2 + log2(span / n) bits each."""
    low = low_bits(len(codes), span)
    high = (codes >> np.uint64(low)).astype(np.int64)
    steps = np.zeros(int(high[-1]) + len(codes) + 1, bool)
    steps[high + np.arange(len(codes))] = True
    bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1, count=None)[:, 64 - low :]
    return np.packbits(bits.ravel()).tobytes() + np.packbits(steps).tobytes()


def unpacked(data: bytes, n: int, span: int) -> np.ndarray:
    low = low_bits(n, span)
    cut = -(-n * low // 8)
    raw = np.frombuffer(data, np.uint8)
    steps = np.flatnonzero(np.unpackbits(raw[cut:]))[:n]
    out = (steps - np.arange(n)).astype(np.uint64) << np.uint64(low)
    if low:
        bits = np.zeros((n, 64), np.uint8)
        bits[:, 64 - low :] = np.unpackbits(raw[:cut])[: n * low].reshape(n, low)
        out |= np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def low_bits(n: int, span: int) -> int:
    return max(0, (span // max(n, 1)).bit_length() - 1)


class Coding:
    """Variants of fingerprints and their codes: hashes of `bits` bits, in ranges of `span` codes."""

    def __init__(self, n_prints: int, radius: int):
        self.masks = ball(radius // 2)
        self.bits = min(BITS, max(1, n_prints * len(self.masks)).bit_length() + SPARE_BITS)
        self.ranges = 1 << max(0, math.ceil(math.log2(max(1, n_prints * len(self.masks) / RANGE))))
        self.span = max(1, (1 << self.bits) // self.ranges)

    def variants(self, prints: np.ndarray) -> np.ndarray:
        return (prints.view(np.uint64)[:, None] ^ self.masks[None, :]).ravel()

    def codes(self, variants: np.ndarray) -> np.ndarray:
        return mixed(variants) >> np.uint64(BITS - self.bits)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each value of the first column, by which they are ordered."""
    now, held = None, []
    for batch in batches:
        name = batch.schema.names[0]
        for r in batch.to_pylist():
            if r[name] != now and held:
                yield now, held
                held = []
            now = r[name]
            held.append(r)
    if held:
        yield now, held


SENT = "range int, block int, n int, codes binary"
MET = "block int, range int, n int, codes binary"


def sent_codes(blocks: DataFrame, coding: Coding) -> DataFrame:
    """SENT: the codes of each block of (block, prints), by ranges."""
    schema = arrow_schema(SENT)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, prints in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = coding.codes(coding.variants(np.frombuffer(prints.as_py(), np.int64)))
                codes.sort()
                edges = np.searchsorted(codes, np.arange(coding.ranges + 1, dtype=np.uint64) * np.uint64(coding.span))
                edges[-1] = len(codes)
                rows = [(i, block, int(b - a), packed(codes[a:b] - np.uint64(i * coding.span), coding.span)) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                for i in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 64]), schema)], schema=schema)

    return blocks.mapInArrow(task, SENT)


def met_codes(sent: DataFrame, coding: Coding) -> DataFrame:
    """MET: per block and range, the codes that occur more than once in all blocks."""
    schema = arrow_schema(MET)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, rows in grouped(batches):
            lists = [unpacked(r["codes"], r["n"], coding.span) for r in rows]
            codes = np.concatenate(lists)
            codes.sort()
            codes = np.unique(codes[1:][codes[1:] == codes[:-1]])
            out = []
            for r, own in zip(rows, lists):
                own = np.intersect1d(own, codes)
                if len(own):
                    out.append((r["block"], i, len(own), packed(own, coding.span)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return sent.repartition(coding.ranges, "range").sortWithinPartitions("range").mapInArrow(task, MET)


def met_variants(blocks: DataFrame, met: DataFrame, coding: Coding, n_blocks: int) -> DataFrame:
    """(variant, print) of each block, for the variants whose code has been met."""
    ddl = "variant long, print long"
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            prints = [np.frombuffer(r["prints"], np.int64) for r in rows if r["prints"] is not None]
            parts = [unpacked(r["codes"], r["n"], coding.span) + np.uint64(r["range"] * coding.span) for r in rows if r["codes"] is not None]
            if not parts:
                continue
            known, prints = np.sort(np.concatenate(parts)), np.concatenate(prints)
            variants = coding.variants(prints)
            codes = coding.codes(variants)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes)
            for i in range(0, len(at), 1 << 16):
                part = at[i : i + (1 << 16)]
                owners = prints[part // len(coding.masks)]
                yield pa.RecordBatch.from_arrays([pa.array(variants[part].view(np.int64)), pa.array(owners)], schema=schema)

    both = blocks.select("block", "prints", F.lit(None).cast("int").alias("range"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("codes"))
    both = both.union(met.select("block", F.lit(None).cast("binary").alias("prints"), "range", "n", "codes"))
    return both.repartition(max(1, n_blocks), "block").sortWithinPartitions("block").mapInArrow(task, ddl)


def print_blocks(distinct: DataFrame, n_blocks: int) -> DataFrame:
    """(block, prints): distinct fingerprints in blocks of about BLOCK, cut where there are more."""
    schema = arrow_schema("block int, prints binary")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.concatenate(held).tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            block, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in np.unique(block):
                if b != now and held:
                    yield rows()
                    held = []
                now = int(b)
                held.append(prints[block == b])
        if held:
            yield rows()

    dealt = distinct.select(F.pmod(F.xxhash64("print"), F.lit(n_blocks)).cast("int").alias("block"), "print")
    return dealt.repartition(n_blocks, "block").sortWithinPartitions("block").mapInArrow(task, "block int, prints binary")


def print_links(distinct: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """(print, leader): links that join all fingerprints of a common variant."""
    n = distinct.count()
    n_blocks = max(1, math.ceil(n / BLOCK))
    coding = Coding(n, radius)
    blocks = scratch.table(print_blocks(distinct, n_blocks), "blocks")
    met = scratch.table(met_codes(sent_codes(blocks, coding), coding), "met")
    rows = met_variants(blocks, met, coding, n_blocks)
    groups = rows.groupBy("variant").agg(F.min("print").alias("leader"), F.collect_set("print").alias("prints")).where(F.size("prints") > 1)
    pairs = groups.select(F.explode("prints").alias("print"), "leader").distinct()
    return pairs.where((F.col("print") != F.col("leader")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("leader"))) <= radius))


def fingerprint_components(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """Per row of `docs`: `key`, fingerprint (16 hex digits), component_id (smallest key reachable by links)."""
    if radius % 2 or not 0 <= radius <= 8:
        raise ValueError("radius is an even number up to 8")
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, key, text), "prints", lasting=True)
    distinct = scratch.table(rows.groupBy("print").agg(F.min("key").alias("first")), "distinct")
    links = scratch.table(print_links(distinct, scratch, radius), "links")
    nodes = links.select(F.explode(F.array("print", "leader")).alias("node")).distinct()
    labels = components(scratch, nodes.select("node", F.col("node").alias("comp")), links)
    named = distinct.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("comp", F.coalesce("comp", "print"))
    smallest = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = scratch.table(named.join(smallest, "comp").select("print", "component_id"), "components", lasting=True)
    scratch.drop()
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return rows.join(named, "print").select(F.col("key").alias(key), digits.alias("fingerprint"), "component_id")
