"""Operator 9: a quality classifier, histogram gradient-boosted trees over document statistics.

Each text becomes one row of FEATURES (counted on its bytes, whole). The features of labelled documents, at
most `max_documents` of them (least key hash), are gathered and binned by quantiles; trees are grown
level by level from histograms of gradients, on the logistic loss. The forest is flattened into
arrays (feature, threshold, value; children of node i are 2i + 1 and 2i + 2), and a batch of rows goes down all
trees together, one numpy step per level.

Null and empty texts are rows of zeros and get a score like any other. Without labels of both classes, every score is the
only class seen, or 0.5 without labels. Repeated keys in the labels count once (their greatest label), repeated keys in the documents once too
(their least row of features); null labels are not used. Empty tables give empty results. Rows are independent; columns of the input other than the text are passed through, except that
a column named as a feature or as the score is replaced.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import arrow_schema, text_slices, with_columns
from folioseek.llm.toxicity import sample_of_labels

SPACE = b" \t\n\r\x0b\f"
CLASSES = {
    "upper": bytes(range(0x41, 0x5B)),
    "lower": bytes(range(0x61, 0x7B)),
    "digit": bytes(range(0x30, 0x3A)),
    "symbol": b"#*$%&|<>=+~^_\\/@",
    "bracket": b"()[]{}",
    "stop": b".?",
    "shout": b"!",
    "comma": b",;:",
    "pipe": b"|",
    "high": bytes(range(0xC0, 0x100)),
    "control": bytes([*range(0, 9), *range(14, 32), 127]),
    "space": SPACE,
}
FEATURES = (
    "characters", "words", "word_length", "long_words", "distinct_words", "short_words", *(f"{c}_share" for c in CLASSES),
    "lines", "repeated_lines", "line_words", "ended_lines", "longest_line", "capital_words", "marked_words", "runs_of_signs",
)


def features_of(text: bytes | None) -> list[float]:
    if not text or not (words := text.split()):
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    characters = size - (size - len(text.translate(None, bytes(range(0x80, 0xC0)))))
    counts = {c: size - len(text.translate(None, b)) for c, b in CLASSES.items()}
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_sizes = [len(x) for x in lines]
    return [
        float(np.log1p(characters)),
        float(np.log1p(n)),
        (size - counts["space"]) / n,
        float((lengths > 15).mean()),
        len(set(words)) / n,
        float((lengths < 4).mean()),
        *(k / size for k in counts.values()),
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        sum(x.rstrip()[-1] in b".!?:;\"'" for x in lines) / len(lines),
        max(line_sizes) / size,
        sum(map(bytes.isupper, words)) / n,
        sum(w[-1] in b"#*$%&!" for w in words) / n,
        (text.count(b"!!") + text.count(b"##") + text.count(b"**") + text.count(b"  ")) / n,
    ]


@dataclass
class Forest:
    """Trees of one depth as arrays (trees x nodes); leaves are the last level of nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, at]] > self.threshold[trees, at]
            at = 2 * at + 1 + right
        total = self.base + self.value[trees, at - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def constant(p: float) -> Forest:
    base = float(np.clip(np.log(max(p, 1e-9) / max(1 - p, 1e-9)), -30, 30))
    return Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), base, 1)


def boost(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 1.0
) -> Forest:
    """The forest for rows x and labels y (0 or 1)."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    margin = np.full(n, base)
    inner = 2**depth - 1
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    offsets = np.arange(k) * bins
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (k * bins) + offsets[None, :] + binned).ravel()
            shape = (width, k, bins)
            gs = np.bincount(slot, np.repeat(g, k), width * k * bins).reshape(shape)
            hs = np.bincount(slot, np.repeat(h, k), width * k * bins).reshape(shape)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < least) | (ha - hl < least)] = 0
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = 0
            flat = gain.reshape(width, -1)
            best = flat.argmax(1)
            split = np.full(width, bins)
            for i in range(width):
                if flat[i, best[i]] > 1e-6:
                    j, b = divmod(int(best[i]), bins)
                    feature[t, first + i], threshold[t, first + i], split[i] = j, cuts[j][b], b
            mine = node - first
            node = 2 * node + 1 + (binned[np.arange(n), feature[t, node]] > split[mine])
        leaf = node - inner
        sums = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[t] = -rate * sums[0] / (sums[1] + ridge)
        margin += value[t, leaf]
    return Forest(feature, threshold, value, base, depth)


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the text, with its FEATURES."""
    kept = [f for f in docs.schema if f.name not in FEATURES and f.name != text]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} double" for n in FEATURES)])
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text):
            columns = zip(*map(features_of, texts))
            yield with_columns(batch, schema, {n: pa.array(c, pa.float64()) for n, c in zip(FEATURES, columns)}, drop=(text, *FEATURES))

    return docs.mapInArrow(task, ddl)


def train(statistics: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_documents: int = 40_000, **options) -> Forest:
    """The forest from `statistics` rows with labels; `labels` holds only rows that may be learnt from."""
    sample = sample_of_labels(labels, key, label, max_documents)
    known = statistics.select(F.col(key).alias("key"), *FEATURES).join(F.broadcast(sample), "key")
    known = known.groupBy("key").agg(F.min(F.struct("label", *FEATURES)).alias("row")).select("key", "row.*")
    # at most max_documents rows of numbers, in an order that does not depend on tasks
    rows = known.toPandas().sort_values(["key", *FEATURES])
    return boost(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float), **options)


def score(statistics: DataFrame, forest: Forest, to: str = "score") -> DataFrame:
    """`statistics` without the features, with the score as column `to`."""
    kept = [f for f in statistics.schema if f.name not in FEATURES and f.name != to]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{to}` double"])
    schema, sent = arrow_schema(ddl), statistics.sparkSession.sparkContext.broadcast(forest)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy() for n in FEATURES])
                found = np.concatenate([forest.scores(x[i : i + 4096]) for i in range(0, len(x), 4096)])
                yield with_columns(batch, schema, {to: pa.array(found)}, drop=(to, *FEATURES))

    return statistics.mapInArrow(task, ddl)
