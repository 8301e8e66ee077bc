"""Vectors: embedding a corpus through a plug-in, coverage, and exact cosine search."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import is_case
from ..functions.text import blank
from .blocks import ScopeMask, Scores, scored_in_tasks, sliced
from .keyword import KEPT, ORDER, score_order, with_depth
from .scope import SCOPE_COLUMNS, Scope, with_scope
from .tables import row_top, written

# --- fixed values ---
EMBED_MAX_CHARS = 1000  # where the embedding service of the system we match cuts; here only where a caller asks for it
EMBED_BATCH = 32
# --- end of fixed values ---

Embedder = Callable[[list[str]], list[list[float]]]


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length, in double; 0 when either side has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, 1, n), lambda e: e.cast("double")) for v in (a, b))

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, e: s + e)

    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((n > 0) & (norms > 0), dot(x, y) / norms).otherwise(0.0)


def embed_corpus(
    rows: DataFrame, make_embedder: Callable[[], Embedder], model: str, max_chars: int | None = None
) -> DataFrame:
    """(doc_id, seq, model, dim, vec) for every non-blank content; always a full rebuild.

    `make_embedder` runs once per task; whole texts (or their first `max_chars`) go out in small batches. A batch that
    comes back short fails the job, and so do vectors of two sizes, in one task or in two.
    """
    content = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    texts = rows.filter(~blank(F.col("content"))).select(
        "doc_id", F.col("seq").cast("int").alias("seq"), content.alias("content")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make_embedder()
        dim = None
        for frame in frames:
            for at in range(0, len(frame), EMBED_BATCH):
                part = frame.iloc[at : at + EMBED_BATCH]
                vectors = embed(part["content"].tolist())
                if len(vectors) != len(part):
                    raise ValueError(f"embedder returned {len(vectors)} vectors for {len(part)} texts")
                sizes = {len(v) for v in vectors} | ({dim} if dim else set())
                if len(sizes) != 1:
                    raise ValueError(f"vector sizes differ within one run: {sorted(sizes)}")
                dim = sizes.pop()
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "seq": part["seq"].to_numpy(),
                        "model": model,
                        "dim": dim,
                        "vec": [np.asarray(v, dtype="float32") for v in vectors],
                    }
                )

    made = written(texts.mapInPandas(run, "doc_id string, seq int, model string, dim int, vec array<float>"), "vectors")
    sizes = made.agg(F.min("dim").alias("least"), F.max("dim").alias("most")).first()
    if sizes["least"] != sizes["most"]:
        raise ValueError(f"vector sizes differ within one run: {sizes['least']} to {sizes['most']}")
    return made


def embedding_stats(vectors: DataFrame) -> DataFrame:
    """(model, dim, n); more than one row means the table mixes models and must be rebuilt."""
    return vectors.groupBy("model", F.coalesce("dim", F.size("vec")).alias("dim")).agg(F.count("*").alias("n"))


def embedding_coverage(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: vectors stored, chunks in the library."""
    done = vectors.agg(F.count("*").alias("n"))
    return chunks.agg(F.count("*").alias("total")).select(done.scalar().alias("embedded"), "total")


def _cosines(scoped: bool):
    def prepare(queries: pa.Table) -> Scores:
        by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lists = queries["query_vec"].combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[sizes > 0]).astype(int):
            at = np.flatnonzero(sizes == dim)
            flat = pc.list_flatten(lists.take(pa.array(at))).to_numpy(zero_copy_only=False)
            by_dim[dim] = at, _unit(flat.astype("float64").reshape(len(at), dim))
        mask = ScopeMask(queries) if scoped else None

        def score(batch: pa.RecordBatch, floor: np.ndarray) -> np.ndarray:
            n = batch.num_rows
            scores = np.zeros((len(lists), n))
            held = batch.column("vec")
            lengths = np.asarray(pc.fill_null(pc.list_value_length(held), 0))
            for dim, (at, block) in by_dim.items():
                rows = np.nonzero(lengths == dim)[0]
                if len(rows):
                    flat = np.asarray(pc.list_flatten(held.take(pa.array(rows)))).astype("float64")
                    scores[np.ix_(at, rows)] = block @ _unit(flat.reshape(len(rows), dim)).T
            if mask:
                mask.apply(scores, batch, None)
            return scores

        return sliced(score, len(lists))

    return prepare


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def vector_rows(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, seq, page_no, content, vec), written: the vectors whose chunk exists, with its text.

    Made once for any number of searches, which then join neither keys nor texts.
    """
    held = vectors.select("doc_id", F.col("seq").cast("int").alias("seq"), "vec")
    text = chunks.select("doc_id", F.col("seq").cast("int").alias("seq"), F.col("page_no").cast("int").alias("page_no"), "content")
    return written(held.join(text, ["doc_id", "seq"]), "vector-rows")


def semantic_search(
    rows: DataFrame,
    queries: DataFrame,
    depth: int = 10,
    scope: Scope | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """Best positive cosines per query: query_id, rank, doc_id, seq, page_no, content, score.

    `rows` are `vector_rows`. Only vectors of the query's own size count. The scope binds without exception. Query vectors
    are sent to the tasks in blocks of measured size, and each task returns the top of its rows with their text.
    """
    queries, max_depth = with_depth(queries, depth, max_depth)
    scoped = bool(scope and scope.active)
    rows = rows.withColumn("is_case", is_case(F.col("doc_id")))
    asked = queries.filter(F.size("query_vec") > 0).select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec"))
    if scoped:
        rows = scope.attach(rows)
        asked = asked.join(with_scope(queries).select("query_id", *SCOPE_COLUMNS), "query_id")
    near = scored_in_tasks(rows, asked, _cosines(scoped), KEPT, max_depth, ORDER)
    top = row_top(near, ["query_id"], score_order("raw"), max_depth)
    top = top.join(queries.select("query_id", "depth"), "query_id").filter(F.col("rank") <= F.col("depth"))
    return top.select("query_id", "rank", "doc_id", "seq", "page_no", "content", F.col("raw").alias("score"))
