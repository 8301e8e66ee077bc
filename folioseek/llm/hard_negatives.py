"""Operator 13: hard negatives by exact integer scores from Kronecker-packed products.

Components become integers, floor(256 x). For the scores of many rows with an anchor, the components of several rows are made
non-negative by a common bias and laid side by side into fields of one wide integer. One multiplication of that integer
with the anchor's (biased) component multiplies them all, and the sums over components stay in their fields, as a
field is as wide as the largest possible sum. The fields are then taken apart and the bias is taken off again:

    sum (x + b)(a + c) - c sum (x + b) - b sum (a + c) + d b c = sum x a       (d components)

The wide integer has 64 bits while two fields fit in; for larger components it is a Python integer of as many bits as needed.

Rows stand in groups of at most GROUP rows, packed once and written. Anchors are sent to the groups in blocks of bounded bytes. A task
keeps the best rows of its anchors and hands on one row per (group, anchor block), so that the rows between tasks grow
neither with the square of the input nor with equal vectors; these are merged by anchor block. First come the positives of
all anchors, then, with their scores as limits, the negatives.

Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of
different lengths are compared as if the shorter ended in zeros; empty vectors score 0. Repeated rows are rows of
their own: a copy of an anchor may be its positive, and copies of an anchor are anchors of their own. Equal scores go by id, null ids
last; rows with a null id are no anchors. Scores beyond +-2^56 count as that (so that 100 times a score is a long). Tables
without anchors, or empty ones, give no rows. Other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import Scratch, arrow_schema

SCALE = 256
GROUP = 4096  # rows of a group
ANCHOR_BYTES = 8 << 20  # of the anchors that are sent to all tasks at a time
TILE = 128  # anchors that are scored against a group at a time
LIMIT = 1 << 56
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Fields:
    """How components are laid into one integer: bias, number of components, bits of a field and fields of an integer."""

    bias: int
    size: int
    bits: int
    count: int
    wide: bool  # Python integers instead of 64 bits

    @staticmethod
    def fitting(low: int, high: int, size: int) -> Fields:
        bias = max(0, -low)
        most = (high + bias) ** 2 * max(size, 1)
        bits = max(1, most.bit_length())
        wide = 2 * bits > 64
        return Fields(bias, size, bits, 16 if wide else 64 // bits, wide)

    @property
    def type(self) -> type:
        return object if self.wide else np.uint64

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """Biased components (size x integers) of rows x size; row r is field r // integers of integer r % integers."""
        words = -(-len(rows) // self.count)
        out = np.zeros((self.size, words), self.type)
        for i in range(self.count):
            part = rows[i * words : (i + 1) * words].T.astype(self.type)
            out[:, : part.shape[1]] += part << self.type(self.bits * i) if not self.wide else part * (1 << self.bits * i)
        return out

    def products(self, anchors: np.ndarray, packed: np.ndarray, n: int) -> np.ndarray:
        """Sums of products (anchors x n rows) of biased components: one multiplication per anchor component and integer."""
        anchors = anchors.astype(self.type)
        total = np.zeros((len(anchors), packed.shape[1]), self.type)
        for j in range(self.size):
            total += anchors[:, j : j + 1] * packed[j]
        mask = (1 << self.bits) - 1
        if self.wide:
            parts = [(total >> self.bits * i) & mask for i in range(self.count)]
        else:
            parts = [((total >> np.uint64(self.bits * i)) & np.uint64(mask)).astype(np.int64) for i in range(self.count)]
        return np.concatenate(parts, axis=1)[:, :n]

    def scores(self, anchors: np.ndarray, packed: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Inner products (anchors x rows) without the bias; `sums` are those of the rows' biased components."""
        own = anchors.sum(axis=1)
        out = self.products(anchors, packed, len(sums)) - self.bias * sums[None, :] - self.bias * own[:, None] + self.size * self.bias**2
        return np.clip(out, -LIMIT, LIMIT).astype(np.int64)

    def biased(self, whole: list[np.ndarray]) -> np.ndarray:
        """Vectors of integers, filled up with zeros, plus the bias."""
        out = np.full((len(whole), self.size), self.bias, object if self.wide else np.int64)
        for i, x in enumerate(whole):
            out[i, : len(x)] += x
        return out


    def dumped(self, x: np.ndarray) -> bytes:
        if not self.wide:
            return x.tobytes()
        return b"".join(int(v).to_bytes(self.bytes, "little") for v in x.ravel())

    def loaded(self, data: bytes, kind: type) -> np.ndarray:
        if not self.wide:
            return np.frombuffer(data, kind)
        return np.array([int.from_bytes(data[i : i + self.bytes], "little") for i in range(0, len(data), self.bytes)], object)

    @property
    def bytes(self) -> int:
        return self.bits * self.count // 8 + 1


def whole(x: float) -> int:
    """floor(256 x), also where 256 x is beyond the doubles."""
    return math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE


def whole_components(column: pa.Array, wide: bool) -> list[np.ndarray]:
    """floor(256 x) of the components of each vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    values = np.array([whole(x) for x in flat.tolist()], object) if wide else np.floor(flat * SCALE).astype(np.int64)
    ends = np.cumsum(np.asarray(pc.list_value_length(column)))
    return np.split(values, ends[:-1]) if len(ends) else []


def taking_part(vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(row, key, label, vector as doubles) of the rows that take part, numbered; to be written, as the numbers are those of one run."""
    x = F.col(vector).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col(label).isNotNull() & x.isNotNull() & ~odd)
    number = F.monotonically_increasing_id().alias("row")
    return rows.select(number, F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), x.alias("vector"))


def columns_of(data: pa.RecordBatch | pa.Table, fields: Fields) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, key (NO_ID for null), label and biased components."""
    row, key, label, vector = (data.column(c) for c in ("row", "key", "label", "vector"))
    vector = vector.combine_chunks() if isinstance(vector, pa.ChunkedArray) else vector
    return np.asarray(row), np.asarray(key.fill_null(NO_ID)), np.asarray(label), fields.biased(whole_components(vector, fields.wide))


PACKED = "n int, row binary, key binary, label binary, sums binary, packed binary"


def packed_groups(vectors: DataFrame, fields: Fields, n: int) -> DataFrame:
    """Groups of about GROUP rows, in the order of their ids, as one row each: PACKED."""
    schema = arrow_schema(PACKED)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []

        def group() -> pa.RecordBatch:
            row, key, label, x = (np.concatenate(c) for c in zip(*waiting))
            order = np.lexsort((row, key))
            row, key, label, x = row[order], key[order], label[order], x[order]
            cells = (len(row), row.tobytes(), key.tobytes(), label.tobytes(), fields.dumped(x.sum(axis=1)), fields.dumped(fields.pack(x)))
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                waiting.append(columns_of(batch.slice(at, GROUP), fields))
                if sum(len(w[0]) for w in waiting) >= GROUP:
                    yield group()
                    waiting.clear()
        if waiting:
            yield group()

    return vectors.repartition(max(1, math.ceil(n / GROUP)), "row").mapInArrow(task, PACKED)


@dataclass
class Anchors:
    """A block of anchors: their rows, ids, labels, biased components, and their positives' scores by place (MISSING: none)."""

    row: np.ndarray
    key: np.ndarray
    label: np.ndarray
    x: np.ndarray
    first_tile: int
    limits: np.ndarray | None = None


MISSING = np.iinfo(np.int64).min
#: The best rows of the anchors of one tile, as arrays: anchor (row), place of its positive, score, id.
BEST = "tile int, anchor binary, place binary, score binary, key binary"


def first_of(by: np.ndarray, k: int) -> np.ndarray:
    """Of ordered group numbers: True for the first k of each group."""
    start = np.concatenate(([True], by[1:] != by[:-1]))
    return np.arange(len(by)) - np.maximum.accumulate(np.where(start, np.arange(len(by)), 0)) < k


def highest(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the k best allowed rows of each anchor, best first; equal scores in the order of rows."""
    held = np.where(allowed, scores, MISSING)
    least = np.partition(held, held.shape[1] - k, axis=1)[:, -k] if held.shape[1] > k else np.full(len(held), MISSING)
    anchor, row = np.nonzero(allowed & (held >= least[:, None]))
    order = np.lexsort((row, -held[anchor, row], anchor))
    anchor, row = anchor[order], row[order]
    keep = first_of(anchor, k) if len(anchor) else slice(0)
    return anchor[keep], row[keep]


def best_of_groups(packed: DataFrame, fields: Fields, block: Anchors, k: int) -> DataFrame:
    """BEST per group and tile of anchors: the positives of anchors without limits, or the negatives by their limits."""
    sent = packed.sparkSession.sparkContext.broadcast(block)
    schema = arrow_schema(BEST)

    def tile(anchors: Anchors, at: slice, group: tuple) -> list[np.ndarray]:
        row, key, label, sums, words = group
        scores = fields.scores(anchors.x[at], words, sums)
        same = anchors.label[at][:, None] == label[None, :]
        found = []
        if anchors.limits is None:
            found.append((0, *highest(scores, same & (anchors.row[at][:, None] != row[None, :]), k)))
        else:
            for place, p in enumerate(anchors.limits[at].T):
                p = np.where(p == MISSING, -1, p)[:, None]  # a negative score allows nothing, and so does none
                found.append((place, *highest(scores, ~same & (30 * p <= 100 * scores) & (100 * scores <= 90 * p), k)))
        columns = [(anchors.row[at][a], np.full(len(a), place), scores[a, r], key[r]) for place, a, r in found]
        return [np.concatenate(c).astype(np.int64) for c in zip(*columns)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                row, key, label = (np.frombuffer(r[c], np.int64) for c in ("row", "key", "label"))
                words = fields.loaded(r["packed"], np.uint64).reshape(fields.size, -(-r["n"] // fields.count))
                group = row, key, label, fields.loaded(r["sums"], np.int64), words
                for t, at in enumerate(range(0, len(anchors.row), TILE)):
                    best = tile(anchors, slice(at, at + TILE), group)
                    if len(best[0]):
                        cells = (anchors.first_tile + t, *(x.tobytes() for x in best))
                        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema)], schema=schema)

    return packed.mapInArrow(task, BEST)


MERGED = "anchor long, place int, rank int, key long, score long"


def merged(best: DataFrame, tiles: int, k: int) -> DataFrame:
    """MERGED: the k best rows of all groups per anchor and place, from BEST; a running best per tile bounds memory."""
    schema = arrow_schema(MERGED)

    def ranked(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        anchor, place, score, key = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((key, -score, place, anchor))
        anchor, place, score, key = anchor[order], place[order], score[order], key[order]
        group = np.cumsum(np.concatenate(([0], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1]))))
        keep = first_of(group, k)
        return [x[keep] for x in (anchor, place, score, key)]

    def rows(best: list[np.ndarray]) -> pa.RecordBatch:
        anchor, place, score, key = best
        start = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1])))
        rank = np.arange(len(anchor)) - np.maximum.accumulate(np.where(start, np.arange(len(anchor)), 0)) + 1
        columns = [anchor, place.astype(np.int32), rank.astype(np.int32), pa.array(key, mask=key == NO_ID), score]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["tile"] != now and held is not None:
                    yield rows(held)
                    held = None
                now = r["tile"]
                new = tuple(np.frombuffer(r[c], np.int64) for c in ("anchor", "place", "score", "key"))
                held = ranked([new] if held is None else [tuple(held), new])
        if held is not None:
            yield rows(held)

    return best.repartition(max(1, tiles), "tile").sortWithinPartitions("tile").mapInArrow(task, MERGED)


def mine(
    vectors: DataFrame,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    every: int = 100,
    n_positives: int = 5,
    n_negatives: int = 10,
) -> DataFrame:
    """Per anchor (id divisible by `every`) and positive (its best rows of the same label): the best rows of other labels with
    30 % to 90 % of the positive's score, as anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    scratch = Scratch(vectors.sparkSession, "negatives")
    rows = scratch.table(taking_part(vectors, key, label, vector), "vectors")
    seen = rows.agg(F.count("*").alias("n"), F.min(F.array_min("vector")).alias("low"), F.max(F.array_max("vector")).alias("high"), F.max(F.size("vector")).alias("size")).first()
    fields = Fields.fitting(whole(seen["low"] or 0.0), whole(seen["high"] or 0.0), seen["size"] or 0)
    packed = scratch.table(packed_groups(rows, fields, seen["n"]), "packed")
    anchors = scratch.table(rows.where(F.col("key") % every == 0), "anchors")

    def best(anchors: DataFrame, label: str, k: int) -> DataFrame:
        n = anchors.count()
        parts, found, tiles = max(1, math.ceil(n * max(fields.size, 8) * 8 / ANCHOR_BYTES)), None, 0
        for part in range(parts):  # one block is gathered, sent, scored, written and released at a time
            data = anchors.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).toArrow()
            block = Anchors(*columns_of(data, fields), first_tile=tiles)
            if "limits" in data.column_names:
                block.limits = np.array([x + [MISSING] * (n_positives - len(x)) for x in data["limits"].to_pylist()], np.int64).reshape(-1, n_positives)
            tiles += math.ceil(len(block.row) / TILE)
            new = scratch.table(best_of_groups(packed, fields, block, k), label)
            found = new if found is None else found.union(new)
        return scratch.table(merged(found, tiles, k), f"merged-{label}", lasting=True)

    positives = best(anchors, "positives", n_positives)
    limits = positives.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("limits"))
    negatives = best(anchors.join(limits, "row"), "negatives", n_negatives)
    ids = anchors.select(F.col("row").alias("anchor"), F.col("key").alias("anchor_id"))
    pairs = positives.join(ids, "anchor").select(
        "anchor", "anchor_id", (F.col("rank") - 1).alias("place"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score")
    )
    pairs = scratch.table(pairs, "pairs", lasting=True)
    scratch.drop()
    out = negatives.join(pairs, ["anchor", "place"])
    return out.select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
