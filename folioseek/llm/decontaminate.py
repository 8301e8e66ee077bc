"""Operator 7: benchmark decontamination with a broadcast set of normalised test n-grams.

Words are runs of digits, letters and all characters from U+0080 on, after A-Z became a-z. A window
is `n` consecutive words of a benchmark item; an item with fewer words, but not none, is one window.
Every document is scanned whole, window by window of each occurring length; a hash finds candidates, and
the words themselves are compared before a hit counts. A document word inside any occurrence is hit.

The benchmark is a stated set. Its size is measured first: it goes to the tasks in blocks of
about `block_bytes` of text, each scanned against all documents in turn. All blocks but the last are scanned in a
job of their own, whose rows are written, and released before the next is gathered: what the driver and the tasks
hold at a time has a fixed bound, and nothing is dropped. Items are dealt to blocks by text and id, so that
many items of one text are parted too. A single item above the bound goes whole.

Null and empty texts have no words and no hits; items without words are never found; equal items
are named each by its own id, repeated ids once, a null id as "null".
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import Scratch, arrow_schema, text_slices, with_columns

#: Bytes that part words, as spaces; A-Z as a-z; all others as they are.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)

FOUND = {"n_words": "long", "hit_spans": "array<struct<start:long,end:long>>", "items": "array<string>"}


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Windows:
    """The windows of a block of items, by length: words -> the ids of the items that hold them."""

    def __init__(self, items: list[tuple[str, bytes | None]], n: int):
        self.ids: dict[bytes, int] = {}
        self.by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            length = min(n, len(words))
            for i in range(len(words) - length + 1) if length else ():
                self.by_length.setdefault(length, {}).setdefault(tuple(words[i : i + length]), set()).add(item)
        self.hashes = {k: np.unique(self.rolled(np.array(list(v), np.int64), k)) for k, v in self.by_length.items()}

    @staticmethod
    def rolled(rows: np.ndarray, length: int) -> np.ndarray:
        """A 64-bit hash of each row of `length` word ids."""
        out = np.zeros(len(rows), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(length):
                out = out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i].astype(np.uint64) + np.uint64(1)
        return out

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words [start, end) and the ids of the items found."""
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        spans, items = [], set()
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for length, windows in self.by_length.items():
            if len(ids) < length:
                continue
            full = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(full):
                continue
            rows = np.lib.stride_tricks.sliding_window_view(ids, length)[full]
            for at in full[np.isin(self.rolled(rows, length), self.hashes[length])].tolist():
                if found := windows.get(tuple(ids[at : at + length].tolist())):
                    spans.append((at, at + length))
                    items |= found
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[tuple[list[tuple[str, bytes | None]], bool]]:
    """The items in blocks, each gathered when it is asked for, and whether it is the last."""
    rows = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("binary").alias("text")
    ).distinct()
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, 2 * math.ceil(size / block_bytes) if size > block_bytes else 1)
    for block in range(n):
        part = rows.where(F.pmod(F.xxhash64("text", "item"), F.lit(n)) == block) if n > 1 else rows
        yield [(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in part.collect()], block == n - 1


def scan_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    n: int = 13,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """`docs` with n_words, hit_spans (merged, in words) and items (sorted as strings) appended."""
    out = docs.select(*(c for c in docs.columns if c not in FOUND)) if text not in FOUND else docs
    scratch = Scratch(docs.sparkSession, "decontaminate")
    for block, last in benchmark_blocks(benchmark, item, item_text, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        out = _scanned(out, sent, text, n)
        if not last:
            out = scratch.table(out, "scanned", lasting=True)
            sent.destroy()
    return out


def _scanned(docs: DataFrame, sent: Broadcast, text: str, n: int) -> DataFrame:
    before = set(FOUND) <= set(docs.columns)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in FOUND]
    ddl = ", ".join([*kept, *(f"{k} {v}" for k, v in FOUND.items())])
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(sent.value, n)
        for batch, texts in text_slices(batches, text):
            new: dict[str, list] = {k: [] for k in FOUND}
            for t in texts:
                words = words_of(t)
                spans, items = windows.find(words)
                new["n_words"].append(len(words))
                new["hit_spans"].append(spans)
                new["items"].append(items)
            if before:
                for k, join in (("hit_spans", merged), ("items", set)):
                    old = batch.column(batch.schema.get_field_index(k)).to_pylist()
                    new[k] = [join([*a, *((x["start"], x["end"]) if k == "hit_spans" else x for x in b)]) for a, b in zip(new[k], old)]
            new["hit_spans"] = [[{"start": a, "end": b} for a, b in s] for s in new["hit_spans"]]
            new["items"] = [sorted(s) for s in new["items"]]
            yield with_columns(batch, schema, new, drop=tuple(FOUND))

    return docs.mapInArrow(task, ddl)


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def is_contaminated(per_hit: int = 20) -> Column:
    """Any word hit, and at least one word in `per_hit`."""
    return (n_hit() > 0) & (n_hit() * per_hit >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, whole and with the columns of `docs`."""
    clash = [c for c in docs.columns if c in FOUND]
    if clash:
        hidden = {c: f"__{c}__" for c in clash}
        renamed = docs.withColumnsRenamed(hidden)
        kept = drop_contaminated(renamed, benchmark, hidden.get(text, text), **options)
        return kept.withColumnsRenamed({v: k for k, v in hidden.items()})
    return scan_benchmark(docs, benchmark, text, **options).where(~is_contaminated()).select(*docs.columns)


def remove_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Scanned `docs` with the hit spans cut out of the text; what parts words stays outside the cuts."""
    schema = arrow_schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))

    def cut(t: bytes, spans: list[dict]) -> bytes:
        flat = t.translate(WORD_BYTES)
        places, at = [], 0
        for w in flat.split():
            at = flat.index(w, at)
            places.append((at, at + len(w)))
            at += len(w)
        out, last = [], 0
        for s in spans:
            out.append(t[last : places[s["start"]][0]])
            last = places[s["end"] - 1][1]
        return b"".join([*out, t[last:]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text):
            spans = batch.column(batch.schema.get_field_index("hit_spans")).to_pylist()
            new = [t if t is None or not s else cut(t, s) for t, s in zip(texts, spans)]
            yield with_columns(batch, schema, {text: pa.array(new, pa.binary()).cast(pa.string())})

    return docs.mapInArrow(task, schema_ddl(docs))


def schema_ddl(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
