"""Operator 12: what each filter removes, in every order, from the removals of all coalitions of filters.

A document fails a set of filters, written as a mask of bits. v(S), the removal of a coalition S, is the number of documents
that fail a filter of S. All counts follow from the 2^n values of v:

* step k of an order, filter f after the filters P: removed v(P + f) - v(P), kept v(all documents) - v(P + f), redundant
  v(f) - removed, and failing f only v(N) - v(N - f). The same differences over labelled documents give what is lost of those.
* the Shapley value of f is the weight phi_f of the additive game that fits v best: least squares over all coalitions but
  the empty and the full one, each weighed by the Shapley kernel (n - 1) / (C(n, s) s (n - s)), under the constraint
  sum phi = v(N). Its normal equations with one multiplier are solved in rationals, so phi is exact; n! phi_f is
  the sum of what f removes over all orders, at any step.

Spark counts documents by (part, mask, labels) and adds them up into one row of 2^n removals per part; the tables of orders
are made from one such row, whatever the number of documents.

The five filters of `document_masks`: A under 100 words; B fewer than 80 distinct words in 100; C over 10 % capital letters
A-Z; D one of # $ % & * |; E the text equals that of a smaller key. Equal texts are found by their SHA-256. Rows
of one key and one text are counted together first, so that neither a key nor a text makes a hot task.

Null texts are empty texts: they fail A, and E from the second key on. Rows with a null key never fail E and are no one's smaller
key. Repeated rows count as often as they stand. A null part is ''. A key with several labels is good or toxic
if one of them says so; null labels say nothing. Very long texts are read whole. Empty tables have no parts and give no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioseek.llm.common import arrow_schema, text_slices

FILTERS = "ABCDE"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = frozenset(b"#$%&*|")
CONTINUED = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that start no code point


def text_mask(text: bytes) -> int:
    """Filters A to D that a text fails: bit i is the i-th filter."""
    words = text.split()
    points = len(text.translate(None, CONTINUED))
    few = len(words) < 100
    dull = 100 * len(set(words)) < 80 * len(words)
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > 10 * points
    return few | dull << 1 | loud << 2 | (not MARKS.isdisjoint(text)) << 3


def document_masks(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(key, part, digest of the text, mask of filters A to D) per row."""
    ddl = f"key {docs.schema[key].dataType.simpleString()}, part string, digest binary, mask int"
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            texts = [t or b"" for t in texts]
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            masks = pa.array([text_mask(t) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema[0].type), batch.column(1), digests, masks], schema=schema)

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(task, ddl)


def label_flags(labels: DataFrame, key: str) -> DataFrame:
    """(key, good, toxic), one row per key."""
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias
    return labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(says("quality")("good"), says("toxic")("toxic"))


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail, A to E."""
    one = document_masks(docs, key, text, part).groupBy("key", "part", "digest", "mask").agg(F.count("*").alias("n"))
    one = one.join(label_flags(labels, key), "key", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    named = F.col("key").isNotNull()
    groups = one.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"),
        F.min(F.when(named, F.struct("key", "n"))).alias("first"),  # the least key here, and how often it stands
    )
    least = F.min("first.key").over(Window.partitionBy("digest"))
    groups = groups.withColumn("repeats", F.col("named") - F.when(F.col("first.key") == least, F.col("first.n")).otherwise(0))
    both = F.array(
        F.struct((F.col("mask") + 16).alias("mask"), F.coalesce("repeats", F.lit(0)).alias("n")),
        F.struct(F.col("mask"), (F.col("n") - F.coalesce("repeats", F.lit(0))).alias("n")),
    )
    rows = groups.select("part", "good", "toxic", F.explode(both).alias("c")).where("c.n > 0")
    total = lambda c, to: F.sum(c).cast("long").alias(to)
    n = F.col("c.n")
    return rows.groupBy("part", F.col("c.mask").alias("mask")).agg(total(n, "n"), total(n * F.col("good"), "good"), total(n * F.col("toxic"), "toxic"))


def coalition_removals(counts: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """(part, total, removed, good, toxic): one row per part; arrays of 2^n removals, at the place of the coalition's mask."""
    counted = ("n", "good", "toxic")
    hit = lambda c, s: F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(c)).otherwise(0))
    arrays = [F.array(*(hit(c, s) for s in range(1 << n_filters))).alias("removed" if c == "n" else c) for c in counted]
    return counts.groupBy("part").agg(F.sum("n").alias("total"), *arrays)


def solved(rows: list[list[Fraction]]) -> list[Fraction]:
    """The solution of a regular linear system, given with its right side as last column, by elimination in rationals."""
    rows = [list(r) for r in rows]
    for i in range(len(rows)):
        pivot = next(j for j in range(i, len(rows)) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(len(rows)):
            if j != i and rows[j][i]:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i])]
    return [r[-1] for r in rows]


def shapley_values(v: Sequence[int]) -> list[Fraction]:
    """Shapley values of the players of v (2^n values, v[0] = 0), by kernel-weighted least squares under sum phi = v(N)."""
    n = (len(v) - 1).bit_length()
    if n == 1:
        return [Fraction(v[1])]
    normal = [[Fraction(0)] * n + [Fraction(1), Fraction(0)] for _ in range(n)]  # the last but one: the multiplier
    for s in range(1, len(v) - 1):
        size = s.bit_count()
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        inside = [i for i in range(n) if s >> i & 1]
        for i in inside:
            for j in inside:
                normal[i][j] += weight
            normal[i][-1] += weight * v[s]
    return solved([*normal, [Fraction(1)] * n + [Fraction(0), Fraction(v[-1])]])[:n]


def order_rows(total: int, removed: Sequence[int], good: Sequence[int], toxic: Sequence[int], names: str = FILTERS) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    n, whole = len(names), len(removed) - 1
    shapley = [int(phi * factorial(n)) for phi in shapley_values(removed)]
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            now = before | 1 << f
            here = removed[now] - removed[before]
            unique = removed[whole] - removed[whole & ~(1 << f)]
            lost = (good[now] - good[before], toxic[now] - toxic[before])
            yield ("".join(names[i] for i in order), step, total - removed[now], here, removed[1 << f] - here, unique, *lost, shapley[f])
            before = now


ORDERS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def filter_orders(removals: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row per part, order and step, from `coalition_removals`."""
    schema = arrow_schema(ORDERS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(r["part"], *x) for x in order_rows(r["total"], r["removed"], r["good"], r["toxic"], names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return removals.mapInArrow(task, ORDERS)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of the five filters over `docs`, per part, order and step."""
    return filter_orders(coalition_removals(mask_counts(docs, labels, key, text, part)))
