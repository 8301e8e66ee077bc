"""Scoring a block of queries against rows inside tasks.

Spark partitions the rows and merges the winners. A task keeps the best `depth` rows of each query over all
its rows and returns them once, at its end. So a task never emits more than queries x depth rows, whatever
the size of batches and slices; a term that most rows hold, or a value that a third of the rows repeat,
adds work but no rows to shuffle.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import written

CELLS = 4_000_000  # scores held at a time: queries x rows
BLOCK_BYTES = 16 << 20  # of queries sent to every task at a time
BLOCK_QUERIES = 500

# batches and the floor per query -> slices of rows, each with its scores (queries x rows)
Scores = Callable[[Iterator[pa.RecordBatch], np.ndarray], Iterator[tuple[pa.RecordBatch, np.ndarray]]]


def query_blocks(queries: DataFrame, block_bytes: int = BLOCK_BYTES, block_queries: int = BLOCK_QUERIES) -> Iterator[DataFrame]:
    """Written queries, cut by hash of their id into parts within both bounds; bytes are measured on whole rows."""
    size = queries.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    parts = max(1, math.ceil((size["bytes"] or 0) / block_bytes), math.ceil(size["n"] / block_queries))
    for part in range(parts):
        yield queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part) if parts > 1 else queries


def sliced(score: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], n_queries: int) -> Scores:
    """A score of rows as `Scores`: batches are cut so that a slice's scores stay within CELLS."""

    def run(batches: Iterator[pa.RecordBatch], floor: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        step = max(1, min(2048, CELLS // max(n_queries, 1)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                yield part, score(part, floor)

    return run


def round9(scores: np.ndarray) -> np.ndarray:
    """The value that ranks a score; the same rounding as in the final order."""
    return np.floor(scores * 1e9 + 0.5)


class Best:
    """The best `depth` rows of each query so far.

    `floor` is each query's depth-th best, 0 while places are free. It is at most the final one, so rows
    below it can be left out.
    """

    def __init__(self, n_queries: int, depth: int, keep: list[str], order: list[tuple[str, str]]):
        self.depth, self.keep = depth, keep
        self.columns = list(dict.fromkeys([*keep, *(c for c, _ in order)]))
        self.sort = [("__query", "ascending"), ("__ranked", "descending"), *order]
        self.floor = np.zeros(n_queries)
        self.rows: pa.Table | None = None

    def add(self, part: pa.RecordBatch, scores: np.ndarray) -> None:
        if not part.num_rows:
            return
        order = pc.sort_indices(part.select([c for c, _ in self.sort[2:]]), sort_keys=self.sort[2:])
        part, scores = part.take(order), scores[:, order.to_numpy()]
        ranked, least = round9(scores), self.floor
        if part.num_rows >= self.depth:
            least = np.maximum(least, np.partition(ranked, -self.depth, axis=1)[:, -self.depth])
        tied = (ranked == least[:, None]) & (scores > 0)
        query, row = np.nonzero((ranked > least[:, None]) | (tied & (np.cumsum(tied, axis=1) <= self.depth)))
        if not len(query):
            return
        at = pa.array(row)
        new = {c: part.column(part.schema.get_field_index(c)).take(at) for c in self.columns}
        new |= {"__query": pa.array(query), "__ranked": pa.array(ranked[query, row]), "__raw": pa.array(scores[query, row])}
        table = pa.table(new)
        if self.rows is not None:
            table = pa.concat_tables([self.rows, table])
        table = table.take(pc.sort_indices(table.select([c for c, _ in self.sort]), sort_keys=self.sort))
        query = table["__query"].to_numpy()
        first = np.concatenate([[True], query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
        last = place == self.depth - 1
        self.floor[query[last]] = table["__ranked"].to_numpy()[last]
        self.rows = table.filter(pa.array(place < self.depth)).combine_chunks()

    def batches(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """(query_id, *keep, raw)."""
        if self.rows is not None:
            columns = [ids.take(self.rows["__query"].combine_chunks()), *(self.rows[c] for c in self.keep), self.rows["__raw"]]
            yield from pa.table(columns, names=["query_id", *self.keep, "raw"]).to_batches(max_chunksize=10_000)


class TermBlock:
    """Terms of a block of queries, ready to be counted in token lists."""

    def __init__(self, lists: pa.ListArray):
        """`lists` holds each query's terms as structs of term and weight; a term weighs the same in all queries."""
        owner = np.asarray(pc.list_parent_indices(lists))
        flat = pc.list_flatten(lists)
        words = pc.struct_field(flat, "term").dictionary_encode()
        code = np.asarray(words.indices)
        self.n_queries, self.vocabulary = len(lists), words.dictionary
        self.weight = np.zeros(len(self.vocabulary))
        self.weight[code] = np.asarray(pc.struct_field(flat, "weight"))
        self.asked_by = owner[np.argsort(code, kind="stable")]
        self.times = np.bincount(code, minlength=len(self.vocabulary))
        self.start = np.cumsum(self.times) - self.times

    def scores(self, tokens: pa.ListArray, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of weight x part(row, count) over the terms a query and a row share."""
        n, v = len(tokens), max(len(self.vocabulary), 1)
        found = np.asarray(pc.fill_null(pc.index_in(pc.list_flatten(tokens), value_set=self.vocabulary), -1))
        row = np.asarray(pc.list_parent_indices(tokens))[found >= 0]
        cell, count = np.unique(row * v + found[found >= 0], return_counts=True)
        row, word = np.divmod(cell, v)
        value = self.weight[word] * part(row, count)
        times = self.times[word]
        before = np.cumsum(times) - times
        query = self.asked_by[np.repeat(self.start[word] - before, times) + np.arange(times.sum())]
        at = query * n + np.repeat(row, times)
        return np.bincount(at, np.repeat(value, times), self.n_queries * n).reshape(self.n_queries, n)


class ScopeMask:
    """Per-query visibility of rows that carry pinned, category and tags."""

    def __init__(self, queries: pa.Table):
        only = queries["only_pinned"].to_pylist()
        category = queries["scope_category"].to_pylist()
        tags = queries["scope_tags"].to_pylist()
        rules: dict[tuple, list[int]] = {}
        for i, (o, c, t) in enumerate(zip(only, category, tags)):
            if o or c is not None or t:
                rules.setdefault((bool(o), c, tuple(sorted(t or ()))), []).append(i)
        # queries of one scope see the same rows: each scope is looked up once
        self.rules = [(at, o, c, pa.array(t, pa.string()) if t else None) for (o, c, t), at in rules.items()]

    def apply(self, scores: np.ndarray, batch: pa.RecordBatch, exempt: np.ndarray | None) -> None:
        if not self.rules or not batch.num_rows:
            return
        n = batch.num_rows
        pinned = np.asarray(pc.fill_null(batch.column("pinned"), False))
        category, tags = batch.column("category"), batch.column("tags")
        owner = np.asarray(pc.list_parent_indices(tags))
        flat = pc.list_flatten(tags)
        for at, only, wanted, any_of in self.rules:
            seen = pinned.copy() if only else np.ones(n, bool)
            if wanted is not None:
                seen &= np.asarray(pc.fill_null(pc.equal(category, wanted), False))
            if any_of is not None:
                has = np.zeros(n, bool)
                has[owner[np.asarray(pc.is_in(flat, value_set=any_of))]] = True
                seen &= has
            if exempt is not None:
                seen |= exempt
            scores[np.ix_(at, ~seen)] = 0.0


def scored_in_tasks(
    rows: DataFrame,
    queries: DataFrame,
    scorer: Callable[[pa.Table], Scores],
    keep: dict[str, str],
    depth: int,
    order: list[tuple[str, str]],
    batch_rows: int | None = None,
) -> DataFrame:
    """(query_id, *keep, raw): the best `depth` rows of each query, from each task.

    `queries` is cut into blocks of bounded size. One block at a time is gathered and sent to the tasks, scored, written
    and released. `scorer(block)` runs once per task. Rows reach it `batch_rows` at a time. `keep` has the columns (with types)
    of the scored slices to return; `order` names those, and directions, that decide between equal scores.
    """
    queries = written(queries, "asked")
    schema = ", ".join([f"query_id {queries.schema['query_id'].dataType.simpleString()}", *map(" ".join, keep.items()), "raw double"])
    out: DataFrame | None = None
    for block in query_blocks(queries):
        shared = rows.sparkSession.sparkContext.broadcast(block.toArrow())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            best = Best(len(asked), depth, list(keep), order)
            for part, scores in scorer(asked)(batches, best.floor):
                best.add(part, scores)
            yield from best.batches(asked["query_id"].combine_chunks())

        with arrow_rows(rows.sparkSession, batch_rows):
            found = written(rows.mapInArrow(run, schema), "near")
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


@contextmanager
def arrow_rows(spark: SparkSession, n: int | None) -> Iterator[None]:
    """Arrow batches of at most n rows for the jobs run inside; large rows would fill memory at the usual number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if n is not None:
        spark.conf.set(name, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(name, before)
