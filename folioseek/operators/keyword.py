"""BM25 for a table of queries over a keyword index, with whole-phrase boost; exact top k.

A search reads the postings of its terms, no others and no texts: by folder, then by row group. They meet by block of chunks, and
scores add up inside the task that has the block; blocks whose bounds cannot reach the result are passed over. Keys and scores of the
best leave the task. As a phrase lifts a hit by a fixed boost, all hits within that boost of a query's last place may
still win; their texts, and no others, are then looked up in the corpus by number, and the phrase is looked for in them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import is_case
from ..functions.text import flat, index_tokens, query_tokens, rounded
from . import blocks
from . import index as ix
from .blocks import ScopeMask, round9
from .index import KeywordIndex, idf, part_of, term_part
from .scope import Scope
from .tables import row_top, written

# --- fixed values ---
PHRASE_BOOST = 2.5
PHRASE_MIN = 2  # characters a query needs, once flattened, to count as a phrase
MATCHED_SHOWN = 6
# --- end of fixed values ---

KEPT = {"doc_id": "string", "seq": "int", "page_no": "int", "content": "string"}
ORDER = [("is_case", "ascending"), ("doc_id", "ascending"), ("seq", "ascending")]
HELD_HITS = 200_000  # hits that a task holds before it leaves out those that cannot win
LISTED = 1000  # terms or blocks that are named in a filter on files; more are joined
SLACK = 1e-6  # room for float addition order when scores are compared with a bound


def score_order(score: str) -> list[Column]:
    """Best first; equal scores keep corpus order: documents before cases, then id and position."""
    return [rounded(F.col(score), 9).desc(), is_case(F.col("doc_id")), F.col("doc_id"), F.col("seq")]


def display_score(raw: Column) -> Column:
    return rounded(1 - 1 / (1 + raw), 3)


def query_terms(index: KeywordIndex, queries: DataFrame) -> DataFrame:
    """(query_id, pos, term, df, idf) for the query terms the corpus knows."""
    asked = queries.select("query_id", F.posexplode(query_tokens(F.col("text"))).alias("pos", "term"))
    return index.terms.join(asked, "term").select(
        "query_id", "pos", "term", "df", idf(F.col("df"), index.n).alias("idf")
    )


class _Hits:
    """Hits of a task: per query the best `depth`, and those that a phrase could lift among them."""

    def __init__(self, boost: np.ndarray, depth: int):
        self.boost, self.depth = boost, depth
        self.floor = np.zeros(len(boost))  # a query's depth-th best score so far
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0
        self.room = HELD_HITS  # hits held when the next cut is due

    def reach(self, scores: np.ndarray) -> np.ndarray:
        """Which scores (queries x any) can still get into the result."""
        return (scores > 0) & (scores + self.boost[:, None] + SLACK >= self.floor[:, None])

    def add(self, scores: np.ndarray, first: int) -> None:
        query, at = np.nonzero(self.reach(scores))
        self.parts.append((query, first + at, scores[query, at]))
        self.n += len(query)
        if self.n > self.room:
            self.cut()
            self.room = self.n + HELD_HITS  # where most may still win, hits are not sorted again for each block

    def cut(self) -> None:
        if not self.parts:
            return
        query, chunk, score = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((chunk, -round9(score), query))
        query, chunk, score = query[order], chunk[order], score[order]
        start = np.concatenate(([True], query[1:] != query[:-1]))[: len(query)]
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(start, np.arange(len(query)), 0))
        last = place == self.depth - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        liftable = (self.boost[query] > 0) & (score + self.boost[query] + SLACK >= self.floor[query])
        keep = (place < self.depth) | liftable
        self.parts, self.n = [(query[keep], chunk[keep], score[keep])], int(keep.sum())

    def batches(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        self.cut()
        for query, chunk, score in self.parts:
            for i in range(0, len(query), 10_000):
                columns = [ids.take(pa.array(query[i : i + 10_000])), pa.array(chunk[i : i + 10_000]), pa.array(score[i : i + 10_000])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_no", "raw"])
        self.parts, self.n, self.room = [], 0, HELD_HITS


class _Asked:
    """The terms of a block of queries by number, and each query's numbers in the order of terms."""

    def __init__(self, queries: pa.Table):
        lists = queries["terms"].combine_chunks()
        flat_terms = pc.list_flatten(lists)
        words, owner = pc.struct_field(flat_terms, "term"), np.asarray(pc.list_parent_indices(lists))
        self.vocabulary = pa.array(sorted(set(words.to_pylist())), pa.string())
        code = self.codes(words)
        self.weight = np.zeros(len(self.vocabulary) + 1)  # the last is that of rows without a term
        self.weight[code] = np.asarray(pc.struct_field(flat_terms, "weight"))
        order = np.lexsort((code, owner))
        self.code, self.ends = code[order], np.searchsorted(owner[order], np.arange(len(lists) + 1))
        self.row = np.full(len(self.vocabulary), -1)

    def codes(self, words: pa.Array) -> np.ndarray:
        return np.asarray(pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1))

    def met(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the terms of a block, some perhaps in two rows: the row for each, and by query (`ends`) the rows of its terms."""
        self.row[code] = np.arange(len(code))
        place, use = self.row[code], self.row[self.code]
        self.row[code] = -1
        return place, use[use >= 0], np.concatenate(([0], np.cumsum(use >= 0)))[self.ends]


def _scored(rows: DataFrame, asked: pa.Table, index: KeywordIndex, depth: int, scoped: bool, id_type: str) -> DataFrame:
    """(query_id, chunk_no, raw) from postings in the order of blocks, with the facets of a block in its first row."""
    shared, avgdl, width = rows.sparkSession.sparkContext.broadcast(asked), index.avgdl, ix.BLOCK
    step = max(1, blocks.CELLS // width)  # terms whose parts are laid out at a time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        n, asked = len(queries), _Asked(queries)
        boost = np.array([PHRASE_BOOST if len(p) >= PHRASE_MIN else 0.0 for p in queries["phrase"].to_pylist()])
        ids, mask, hits = queries["query_id"].combine_chunks(), ScopeMask(queries) if scoped else None, _Hits(boost, depth)

        def score(block: int, pieces: list[tuple[np.ndarray, ...]], facets: pa.StructArray | None) -> None:
            code, size, at, part, most = (np.concatenate(c) if len(pieces) > 1 else c[0] for c in zip(*pieces))
            place, use, ends = asked.met(code)
            best = np.zeros(len(code))
            np.maximum.at(best, place, asked.weight[code] * most)
            bound = np.bincount(np.repeat(np.arange(n), np.diff(ends)), best[use], n)
            live = hits.reach(bound[:, None])[:, 0]
            if not live.any():
                return
            scores, row = np.zeros((n, width)), np.repeat(place, size)
            for first in range(0, len(code), step):
                inside = (row >= first) & (row < first + step)
                parts = np.zeros((min(step, len(code) - first) + 1, width))
                parts[row[inside] - first + 1, at[inside]] = part[inside]
                for q in np.flatnonzero(live):  # terms add up one after the other in their order, so copies score alike in all blocks
                    rows = use[ends[q] : ends[q + 1]] - first + 1
                    rows = rows[(rows > 0) & (rows <= step)]
                    if len(rows):
                        parts[0] = scores[q]
                        np.add.reduce(parts[np.append(0, rows)], axis=0, out=scores[q])
            if mask:
                mask.apply(scores, *_facet_rows(facets, width))
            hits.add(scores, block * width)

        now, pieces, facets = None, [], None
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            blocks_of, most = column["block"].to_numpy(), column["most"].to_numpy(zero_copy_only=False)
            code = asked.codes(column["term"])
            size = np.asarray(pc.fill_null(pc.list_value_length(column["at"]), 0))  # the three lists of a row are of one length
            at, tf, dl = (np.asarray(pc.list_flatten(column[c])) for c in ("at", "tf", "dl"))
            part = np.repeat(asked.weight[code], size) * term_part(tf, dl, avgdl)
            ends = np.concatenate(([0], np.cumsum(size)))
            starts = np.concatenate(([0], np.flatnonzero(np.diff(blocks_of)) + 1, [len(code)]))
            for a, b in zip(starts[:-1], starts[1:]):
                if a == b:
                    continue
                if blocks_of[a] != now:
                    if pieces:
                        score(now, pieces, facets)
                        if hits.n > 2 * HELD_HITS:  # hits that all may win; what they leave behind is the floor
                            yield from hits.batches(ids)
                    now, pieces, facets = blocks_of[a], [], None
                if code[a] < 0:
                    facets, a = column["facets"][a].values, a + 1
                if a < b:
                    held = slice(ends[a], ends[b])
                    pieces.append((code[a:b], size[a:b], at[held], part[held], most[a:b]))
        if pieces:
            score(now, pieces, facets)
        yield from hits.batches(ids)

    return rows.mapInArrow(run, f"query_id {id_type}, chunk_no bigint, raw double")


def _facet_rows(facets: pa.StructArray | None, width: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The facets of a block's chunks by their places, and which of them are cases."""
    kinds = {"pinned": pa.bool_(), "category": pa.string(), "tags": pa.list_(pa.string())}
    if facets is None:
        return pa.RecordBatch.from_arrays([pa.nulls(width, kind) for kind in kinds.values()], names=list(kinds)), np.zeros(width, bool)
    of = np.full(width, -1)
    of[np.asarray(facets.field("at"))] = np.arange(len(facets))
    places = pa.array(of, mask=of < 0)
    rows = pa.RecordBatch.from_arrays([pc.cast(pc.struct_field(facets, c), kind).take(places) for c, kind in kinds.items()], names=list(kinds))
    return rows, np.asarray(pc.fill_null(pc.struct_field(facets, "is_case").take(places), False))


def _facets(index: KeywordIndex, scope: Scope) -> DataFrame:
    """(block, facets): what the scope looks at, of all chunks of a block; texts are not read."""
    seen = scope.docs.select("doc_id", "pinned", "category", "tags")
    rows = index.corpus.select("block", "at", "doc_id").join(seen, "doc_id", "left")
    facet = F.struct("at", is_case(F.col("doc_id")).alias("is_case"), "pinned", "category", "tags")
    return rows.groupBy("block").agg(F.collect_list(facet).alias("facets"))


def term_postings(index: KeywordIndex, terms: list[str], parts: list[int]) -> DataFrame:
    """The postings of the terms: of their folders, and there of the row groups that can hold them."""
    rows = index.postings.where(F.col("part").isin(parts))
    if len(terms) <= LISTED:
        return rows.where(F.col("term").isin(terms))
    named = rows.sparkSession.createDataFrame(pa.table({"term": terms}))
    return rows.where(F.col("term").between(min(terms), max(terms))).join(F.broadcast(named), "term", "left_semi")  # bounded by the block of queries


def near_hits(index: KeywordIndex, asked: DataFrame, depth: int, scope: Scope | None) -> DataFrame:
    """(query_id, chunk_no, raw): the best hits before the phrase boost, and all that it may lift; one block of queries at a time."""
    out: DataFrame | None = None
    facets = None if scope is None else written(_facets(index, scope), "facets")
    for block in blocks.query_blocks(written(asked, "asked")):
        queries = block.toArrow()
        named = {t["term"]: t["part"] for terms in queries["terms"].to_pylist() for t in terms}
        rows = term_postings(index, sorted(named), sorted(set(named.values()))).select("block", "term", "at", "tf", "dl", "most")
        if facets is not None:
            held = rows.select("block").distinct()
            rows = rows.unionByName(facets.join(held, "block", "left_semi"), allowMissingColumns=True)
        rows = rows.repartition("block").sortWithinPartitions("block", F.col("term").asc_nulls_first())
        found = blocks.written(_scored(rows, queries, index, depth, scope is not None, asked.schema["query_id"].dataType.simpleString()), "near")
        out = found if out is None else out.unionByName(found)
    return out


def chunks_of(index: KeywordIndex, keys: DataFrame) -> DataFrame:
    """`keys` (written, with chunk_no) with doc_id, seq, page_no and content; few blocks are looked up by name, many are joined."""
    wanted = keys.select(F.floor(F.col("chunk_no") / ix.BLOCK).alias("block")).distinct().limit(LISTED + 1).collect()
    corpus = index.corpus
    if len(wanted) <= LISTED:
        corpus = corpus.where(F.col("block").isin([r["block"] for r in wanted]))
    return keys.join(corpus.select("chunk_no", "doc_id", "seq", "page_no", "content"), "chunk_no")


def with_depth(queries: DataFrame, depth: int, max_depth: int | None) -> tuple[DataFrame, int]:
    """Queries with a depth each, and the largest depth."""
    if "depth" not in queries.columns:
        return queries.withColumn("depth", F.lit(depth)), depth
    return queries, max_depth or queries.agg(F.max("depth")).first()[0] or depth


def keyword_search(
    index: KeywordIndex,
    queries: DataFrame,
    depth: int = 10,
    scope: Scope | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """Top hits per query: query_id, rank, doc_id, seq, page_no, content, raw, score, matched.

    `queries` needs query_id and text, and may give its own `depth`.
    """
    queries, max_depth = with_depth(queries, depth, max_depth)
    scope = scope if scope and scope.active else None
    terms = written(query_terms(index, queries), "query-terms")
    part = part_of(F.col("term"), index.parts).alias("part")
    packed = F.collect_list(F.struct("term", F.col("idf").alias("weight"), part))
    phrases = queries.select("query_id", flat(F.col("text")).alias("phrase"))
    asked = terms.groupBy("query_id").agg(packed.alias("terms")).join(phrases, "query_id")
    if scope:
        asked = asked.join(scope.queries, "query_id")
    near = near_hits(index, asked, max_depth, scope)
    last = row_top(near, ["query_id"], [rounded(F.col("raw"), 9).desc(), F.col("chunk_no")], max_depth)
    last = last.where(F.col("rank") == max_depth).select("query_id", F.col("raw").alias("least"))
    phrase = F.when(F.length("phrase") >= PHRASE_MIN, F.col("phrase"))
    near = near.join(last, "query_id", "left").join(phrases.select("query_id", phrase.alias("phrase")), "query_id")
    lift = F.when(F.col("phrase").isNotNull(), PHRASE_BOOST).otherwise(0.0)
    near = written(near.where(F.col("least").isNull() | (F.col("raw") + lift + SLACK >= F.col("least"))).drop("least"), "candidates")
    boost = F.when(F.contains(flat(F.coalesce("content", F.lit(""))), F.col("phrase")), PHRASE_BOOST).otherwise(0.0)
    best = chunks_of(index, near).withColumn("raw", F.col("raw") + boost).drop("phrase")
    top = row_top(best, ["query_id"], score_order("raw"), max_depth).join(queries.select("query_id", "depth"), "query_id")

    wanted = F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("weight"), "pos", "term")))
    known = terms.groupBy("query_id").agg(wanted.alias("asked"))
    # One look at the tokens of a hit: a test inside a lambda would cut its text into tokens again for each term.
    present = F.array_intersect(F.transform("asked", lambda a: a["term"]), index_tokens(F.col("content")))
    return (
        top.filter(F.col("rank") <= F.col("depth"))
        .join(known, "query_id")
        .select(
            "query_id",
            "rank",
            "doc_id",
            "seq",
            "page_no",
            "content",
            "raw",
            display_score(F.col("raw")).alias("score"),
            F.slice(present, 1, MATCHED_SHOWN).alias("matched"),
        )
    )
