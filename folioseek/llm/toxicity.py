"""Operator 3: toxicity by a support vector machine on a gapped subsequence kernel with Nyström landmarks.

The unit that is classified is a fragment: a word without the marks around it (letters that stand for letters, as 1 for i
and @ for a, read as such), a row of single letters written apart, or, for longer strings, windows of
MAX_LETTERS letters; the ends of a word count as letters. The kernel compares two fragments by their common subsequences
of ORDER letters within SPAN, each weighed by DECAY for every letter that it spans, so inserted and left-out characters
cost a little and no more. Vectors are divided by the length that a fragment of as many different letters has.

Training, from documents with labels:

1. Of copies and near copies one document stays; a fifth of the rest is kept for the last step. Words and word starts that
   stand in toxic documents far more often than chance allows (log-likelihood, against the number of groups seen) mark the
   first insulting words. Other words of clean documents are the other class.
2. Landmarks are fragments of both classes, the commonest and others chosen apart from each other. K(x, L) K(L, L)^-1/2 gives each
   fragment coordinates, on which a linear squared-hinge machine is fitted. A word weighs as much as the documents it stands in.
3. Sentences get labels: those of clean documents are clean, and of toxic documents those in which the machine finds an insult are toxic.
   Each sentence is then represented by its witness, the word with the highest score, and the machine is fitted again
   on the witnesses of both classes, twice: a sentence is clean only if its worst word is.
4. As the kernel is a sum over subsequences, the machine is folded into one weight per subsequence: the
   score of a fragment is the same number with or without folding, and needs no landmark afterwards.
5. A logistic curve on a document's two best fragments and their number gives its score, 0 to 1. It is fitted on the
   documents kept, both classes of equal weight, and moved so that their balance lies at FROM.

Bounds of the fit, all parameters: at most `max_documents` labelled documents (those of least key hash, one row per key), `max_words`
words of each class (of most documents, then of highest score) and `max_groups` marked starts. Counts of letter groups and witnesses are added up by Spark.
Scoring reads whole texts. Null and empty texts have no fragments and get
the score of a text without insults. Without labels of both classes all scores are 0. Repeated keys
in the labels count once (toxic if any is); null labels are not used.
"""
from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import Memo, Scratch, arrow_schema, text_slices, with_columns
from folioseek.llm.jaccard import WordHashes, shingle_sets

DECAY = 0.6
ORDER, SPAN = 4, 10  # letters of a subsequence, and letters that it spans at most
MAX_LETTERS = 12
MIN_LETTERS = 3
START, END = "\x02", "\x03"  # the ends of a word
LETTERS = 40  # classes of letters: a to z, the ends, others by code point
FEATURES = LETTERS**ORDER
COLUMNS = 64  # landmarks whose vectors are held as a table at a time
GROUPS = range(3, 9)  # letters of the starts of words
FROM = 0.3  # the score at which the curve puts the balance between both classes
SENTENCE = re.compile(rb"[.!?\n]+")

#: Characters that are written for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
INNER = regex.compile(r"[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", regex.DOTALL)
NO_LETTER, LETTER = regex.compile(r"\P{L}+"), regex.compile(r"\p{L}")
DRAWN_OUT = re.compile(r"([^\W\d_])\1{2,}")
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Lengths of runs as bytes, to find rows of single letters.
SHORT = defaultdict(lambda: 2, {1: 1})
ONES = b"\x01\x01\x01"
APART = regex.compile(rb"(?<![^\s])(?:[A-Za-z][\s.\-_*]+){2,}[A-Za-z](?![^\s])")


def letters_of(run: bytes) -> str:
    """The letters of a run without ASCII white space, in lower case, lookalikes read as letters, drawn-out letters once."""
    run = run.strip(MARKS)
    if run.isalpha():  # ASCII letters only
        word = run.decode().lower()
    elif m := INNER.search(run.decode("utf-8", "replace")):
        word = m.group().lower()
        if not word.isalpha():
            word = NO_LETTER.sub("", word.translate(LOOKALIKES)) if LETTER.search(word) else ""
    else:
        return ""
    return DRAWN_OUT.sub(r"\1", word)


def fragments(word: str) -> list[str]:
    """The word with its ends, or its windows."""
    if len(word) < MIN_LETTERS:
        return []
    word = f"{START}{word}{END}"
    if len(word) <= MAX_LETTERS + 2:
        return [word]
    step = MAX_LETTERS // 2
    return [word[i : i + MAX_LETTERS] for i in range(0, len(word) - MAX_LETTERS + step, step)]


def coded(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letter classes."""
    points = np.array([list(map(ord, w)) for w in words], np.int32)
    small = np.where(points < 32, 25 + points, 29 + points % (LETTERS - 29))  # the ends are 27 and 28
    return np.where((points >= 97) & (points <= 122), points - 96, small)


@cache
def places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all subsequences in a fragment of this length, and their weights; the squares add up to 1."""
    near = [c for c in combinations(range(length), ORDER) if c[-1] - c[0] < SPAN]
    at = np.array(near, np.int32).T
    weights = DECAY ** (at[-1] - at[0] + 1).astype(np.float64)
    return at, (weights / np.sqrt((weights**2).sum())).astype(np.float32)


def subsequences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (words x subsequences), and the weight of each place."""
    at, weights = places(rows.shape[1])
    number = rows[:, at[0]]
    for k in range(1, ORDER):
        number = number * LETTERS + rows[:, at[k]]
    return number, weights


def by_length(words: list[str], most: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words of one length at a time, at most `most`, with their places in the list."""
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for at in groups.values():
        for i in range(0, len(at), most):
            yield np.array(at[i : i + most]), [words[j] for j in at[i : i + most]]


def vectors(words: list[str]) -> list[dict[int, float]]:
    """The vectors of a few words, as dictionaries."""
    out: list[dict[int, float]] = [{}] * len(words)
    for at, same in by_length(words, 512):
        features, weights = subsequences(coded(same))
        for i, row in zip(at, features):
            v: dict[int, float] = defaultdict(float)
            for f, w in zip(row.tolist(), weights.tolist()):
                v[f] += w
            out[i] = dict(v)
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values, words x landmarks, for COLUMNS landmarks at a time."""
    out = np.zeros((len(words), len(landmarks)))
    for j in range(0, len(landmarks), COLUMNS):
        out[:, j : j + COLUMNS] = _kernel(words, vectors(landmarks[j : j + COLUMNS]))
    return out


def _kernel(words: list[str], sparse: list[dict[int, float]]) -> np.ndarray:
    known = np.unique(np.array([f for v in sparse for f in v], np.int64))
    row_of = np.full(FEATURES, len(known), np.int32)  # the last row is for all other features
    row_of[known] = np.arange(len(known))
    dense = np.zeros((len(known) + 1, len(sparse)), np.float32)
    for j, v in enumerate(sparse):
        dense[row_of[list(v)], j] = list(v.values())
    out = np.zeros((len(words), len(sparse)))
    for at, same in by_length(words, 128):
        features, weights = subsequences(coded(same))
        out[at] = np.matmul(weights, dense[row_of[features]])
    return out


@dataclass
class Machine:
    """The folded machine (weight per subsequence, offset) and the curve of documents."""

    weights: np.ndarray
    offset: float
    curve: np.ndarray  # offset, best, second, log(1 + number)

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for at, same in by_length(words, 1024):
            features, weights = subsequences(coded(same))
            out[at] = self.weights[features] @ weights
        return out + self.offset

    def document(self, found: np.ndarray) -> np.ndarray:
        """Score of documents from rows (best, second, number)."""
        x = self.curve[0] + found[:, 0] * self.curve[1] + found[:, 1] * self.curve[2] + np.log1p(found[:, 2]) * self.curve[3]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


NEVER = Machine(np.zeros(FEATURES, np.float32), -1.0, np.array([-30.0, 0, 0, 0]))
LEAST = -2.0  # the score of no fragment


class _Scores(Memo):
    """run -> score of its best fragment."""

    def __init__(self, machine: Machine, limit: int = 200_000):
        super().__init__(limit)
        self.machine = machine

    def learn(self, runs: list[bytes]) -> None:
        self.room(min(len(runs), self.limit // 2))
        new = [r for r in set(runs) if r not in self]
        parts, owner = [], []
        for i, run in enumerate(new):
            for f in fragments(letters_of(run)):
                parts.append(f), owner.append(i)
        best = np.full(len(new), LEAST)
        if parts:
            np.maximum.at(best, np.array(owner), self.machine.scores(parts))
        self.update(zip(new, best.tolist()))


def runs_of(text: bytes | None) -> list[bytes]:
    """Runs of a text in lower case (A-Z), and the rows of letters written apart as runs of their own."""
    if not text:
        return []
    runs = text.lower().split()
    if ONES in bytes(map(SHORT.__getitem__, map(len, runs))):
        runs += [b"".join(m.split()).lower() for m in APART.findall(text)]
    return runs


def document_parts(texts: list[bytes | None], scores: _Scores) -> np.ndarray:
    """(best, second best, number of insulting words) of each text; an insult that is said twice is also second."""
    out = np.full((len(texts), 3), LEAST)
    out[:, 2] = 0
    step = scores.limit // 4
    waiting: list[tuple[int, list[bytes], list[bytes]]] = []
    unknown: set[bytes] = set()

    def finish() -> None:
        if unknown:
            scores.learn(list(unknown))  # words of many texts at once
            unknown.clear()
        for i, said, runs in waiting:
            out[i] = _parts_of(said, _values(runs, scores, step), runs)
        waiting.clear()

    for i, text in enumerate(texts):
        said = runs_of(text)
        runs = list(set(said))
        if not runs:
            continue
        new = [r for r in runs if r not in scores]
        if len(unknown) + len(new) > step:
            finish()
        waiting.append((i, said, runs))
        unknown.update(new[:step])
    finish()
    return out


def _values(runs: list[bytes], scores: _Scores, step: int) -> np.ndarray:
    values = np.empty(len(runs))
    for a in range(0, len(runs), step):  # a long text in parts, as the memo is bounded
        part = runs[a : a + step]
        try:
            values[a : a + step] = list(map(scores.__getitem__, part))
        except KeyError:
            scores.learn(part)
            values[a : a + step] = list(map(scores.__getitem__, part))
    return values


def _parts_of(said: list[bytes], values: np.ndarray, runs: list[bytes]) -> tuple[float, float, float]:
    first = int(values.argmax())
    best = values[first]
    values[first] = LEAST
    second, number = values.max(), 0
    if best > 0:
        times = said.count(runs[first])
        second = best if times > 1 else second
        insults = {runs[j] for j in np.flatnonzero(values > 0)}
        number = times + (sum(r in insults for r in said) if insults else 0)
    return max(best, LEAST), max(second, LEAST), number


def sample_of_labels(labels: DataFrame, key: str, label: str, limit: int) -> DataFrame:
    """At most `limit` labelled keys, of least hash: (key, label)."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    one = known.groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("key"), "key").limit(limit)


def letter_groups(docs: DataFrame, text: str) -> DataFrame:
    """(gram, toxic, n): distinct words and starts of words, with the labelled documents that hold them."""
    schema = arrow_schema("gram string, toxic long, n long")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = [list(counts), [c[0] for c in counts.values()], [c[1] for c in counts.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch, texts in text_slices(batches, text):
            for t, label in zip(texts, batch.column(batch.schema.get_field_index("label")).to_pylist()):
                grams = set()
                for word in {letters_of(r) for r in set(runs_of(t))}:
                    if len(word) >= MIN_LETTERS:
                        grams.add(f" {word} ")
                        grams.update(f" {word[:k]}" for k in GROUPS if k <= len(word))
                for g in grams:
                    c = counts.setdefault(g, [0, 0])
                    c[0] += label
                    c[1] += 1
                if len(counts) > 100_000:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    parts = docs.select("label", text).mapInArrow(task, "gram string, toxic long, n long")
    return parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def farthest(words: list[str], n: int, first: int) -> list[str]:
    """Up to n of the words: the `first` ones, then of some 600 of the others, evenly chosen, each the one least like those before it."""
    if len(words) <= n:
        return words
    chosen, others = words[: max(1, first)], words[max(1, first) :]
    others = others[:: max(1, len(others) // 600)]
    near, alike = kernel(others, chosen).max(axis=1), kernel(others, others)
    while len(chosen) < n and near.min() < 2:
        at = int(np.argmin(near))
        chosen.append(others[at])
        near = np.maximum(near, alike[:, at])
        near[at] = 2
    return chosen


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, loss: str) -> np.ndarray:
    """Weights of a linear model with offset (first), by Newton steps on the squared hinge or the logistic loss."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    sign = np.where(y > 0, 1.0, -1.0)
    for _ in range(30):
        m = sign * (x @ w)
        if loss == "hinge":
            slope, bend = -sign * np.maximum(0, 1 - m), (m < 1).astype(float)
        else:
            p = 1 / (1 + np.exp(np.clip(m, -30, 30)))
            slope, bend = -sign * p, np.maximum(p * (1 - p), 1e-6)
        gradient = x.T @ (weight * slope) + penalty * w
        step = np.linalg.solve((x * (weight * bend)[:, None]).T @ x + np.diag(penalty), gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_documents: int = 15_000,
    max_words: int = 6_000,
    max_groups: int = 1_000,
    n_landmarks: int = 320,
    rounds: int = 2,
) -> Machine:
    """The machine from the labelled documents; `labels` holds only rows that may be learnt from."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    sample = scratch.table(sample_of_labels(labels, key, label, max_documents), "sample")
    known = scratch.table(one_of_each(picked(source, sample)), "known")
    fold = F.pmod(F.xxhash64("key", F.lit("curve")), F.lit(5)) == 0
    told = {(r["kept"], r["label"]): r["count"] for r in known.groupBy(fold.alias("kept"), "label").count().collect()}
    if min(told.get((True, c), 0) for c in (0, 1)) < 3:  # too few to keep some
        learnt, kept = known, known
        told = {(False, c): told.get((False, c), 0) + told.get((True, c), 0) for c in (0, 1)}
    else:
        learnt, kept = known.where(~fold), known.where(fold)
    n, positives = told.get((False, 0), 0) + told.get((False, 1), 0), told.get((False, 1), 0)
    machine = learnt_words(learnt, positives / n, scratch, max_words, max_groups, n_landmarks, rounds) if 0 < positives < n else NEVER
    if machine is not NEVER:
        parts = document_features(kept, machine, "text").select("label", "best", "second", "number")
        rows = np.array(sorted(tuple(r) for r in parts.collect()))  # at most max_documents rows
        machine.curve = balanced_curve(np.column_stack([rows[:, 1], rows[:, 2], np.log1p(rows[:, 3])]), rows[:, 0])
    scratch.drop()
    return machine


def balanced_curve(features: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The logistic curve of both classes at equal weight, with its middle at FROM."""
    weight = np.where(label > 0, 0.5 / max(1, (label > 0).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
    curve = fitted(features, label, weight, 0.1, "logistic")
    curve[0] += math.log(FROM / (1 - FROM))
    return curve


def learnt_words(docs: DataFrame, rate: float, scratch: Scratch, max_words: int, max_groups: int, n_landmarks: int, rounds: int) -> Machine:
    """The machine of words of the documents (label, text); its curve is still to be fitted."""
    groups = scratch.table(letter_groups(docs, "text"), "groups")
    total = groups.count()
    t, n = F.col("toxic"), F.col("n")
    share = t / n
    part = lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0)
    gain = n * (part(share, F.lit(rate)) + part(1 - share, F.lit(1 - rate)))
    marked = groups.where((n >= 3) & (share > 0.5 + rate / 2) & (gain > math.log(max(total, 2)) + 2))
    marked = [r["gram"] for r in marked.orderBy(gain.desc(), "gram").limit(max_groups).collect()]
    if not marked:
        return NEVER
    words = groups.where(F.col("gram").startswith(" ") & F.col("gram").endswith(" ")).withColumn("word", F.trim("gram"))
    hit = F.col("gram").rlike("|".join(regex.escape(g) for g in marked))
    first = lambda df, order: {r["word"]: float(r["weight"]) for r in df.orderBy(*order).limit(max_words).collect()}
    spoken = first(words.where(hit & (share > 0.5)).select("word", t.alias("weight")), [F.col("weight").desc(), "word"])
    innocent = words.where(~hit & (share <= rate)).select("word", F.lit(1).alias("weight"), n.alias("n"))
    clean = first(innocent, [F.col("n").desc(), "word"]) | first(innocent, [F.xxhash64("word"), "word"])
    machine = fit_words(spoken, clean, n_landmarks)
    for _ in range(rounds):
        seen = scratch.table(witnesses(docs, machine), "witnesses")
        toxic, all_of_it = F.col("toxic"), F.col("n")
        spoken = spoken | first(seen.where((toxic >= 2) & (toxic > all_of_it * 0.8)).select("word", toxic.alias("weight")), [F.col("weight").desc(), "word"])
        worst = seen.where((toxic == 0) & (F.col("score") > -1)).select("word", (1 + F.log(all_of_it)).alias("weight"), "score")
        clean = clean | {w: c for w, c in first(worst, [F.col("score").desc(), "word"]).items() if w not in spoken}
        machine = fit_words(spoken, clean, n_landmarks)
    return machine


def witnesses(docs: DataFrame, machine: Machine) -> DataFrame:
    """(word, toxic, n, score): the words with the highest score of labelled sentences, with the numbers of those sentences."""
    ddl = "word string, toxic long, n long, score double"
    schema, sent = arrow_schema(ddl), docs.sparkSession.sparkContext.broadcast(machine)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(sent.value)
        for batch, texts in text_slices(batches, "text"):
            counts: dict[str, list] = {}
            for text, label in zip(texts, batch.column(batch.schema.get_field_index("label")).to_pylist()):
                sentences = [s for s in (list(dict.fromkeys(runs_of(x))) for x in SENTENCE.split(text or b"")) if s]
                for runs in sentences:
                    values = _values(runs, scores, scores.limit // 4)
                    at = int(values.argmax())
                    word = letters_of(runs[at])
                    if values[at] > (0 if label else LEAST) and word:  # sentences of toxic documents without an insult have no label
                        c = counts.setdefault(word, [0, 0, float(values[at])])
                        c[0] += label
                        c[1] += 1
            columns = [list(counts), *(list(c) for c in zip(*counts.values()))] if counts else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    parts = docs.select("label", "text").mapInArrow(task, ddl)
    return parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"), F.max("score").alias("score"))


def picked(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(key, label, text): the documents of the sample, one row per key (of rows that repeat a key, that of the least text)."""
    return docs.join(sample, "key").groupBy("key", "label").agg(F.min("text").alias("text"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without most of the copies and near copies: of documents with the same least shingle one stays.

    A copied toxic text would make all its words look toxic.
    """
    ddl = f"key {docs.schema['key'].dataType.simpleString()}, label int, text binary, least long"
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch, texts in text_slices(batches, "text"):
            least = [int(s[0]) - (1 << 63) if len(s) else None for s in shingle_sets(texts, memo)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(schema[i].type) for i in range(3)), pa.array(least, pa.int64())], schema=schema)

    known = docs.select("key", F.col("label").cast("int").alias("label"), "text").mapInArrow(task, ddl)
    alike = F.coalesce(F.col("least"), F.xxhash64("key"))
    return known.groupBy(alike.alias("alike")).agg(F.min(F.struct("key", "label", "text")).alias("d")).select("d.*")


def fit_words(spoken: dict[str, float] | list[str], clean: dict[str, float] | list[str], n_landmarks: int) -> Machine:
    """The machine of words of both classes, with their weights; its curve is still to be fitted."""

    def parts(words: dict[str, float] | list[str]) -> dict[str, float]:
        words = words if isinstance(words, dict) else dict.fromkeys(words, 1.0)
        out: dict[str, float] = defaultdict(float)
        for w, c in words.items():
            for f in fragments(w):
                out[f] += c
        return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))

    positive = parts(spoken)
    negative = {f: c for f, c in parts(clean).items() if f not in positive}
    if not positive or not negative:
        return NEVER
    words = [*positive, *negative]
    y = np.array([1] * len(positive) + [-1] * len(negative))
    weight = np.array([*positive.values(), *negative.values()])
    for side in (1, -1):  # each class weighs the same
        weight[y == side] *= 500 / weight[y == side].sum()
    landmarks = farthest(list(positive), n_landmarks // 2, n_landmarks // 8)
    landmarks = landmarks + farthest(list(negative), n_landmarks - len(landmarks), n_landmarks // 8)
    values, axes = np.linalg.eigh(kernel(landmarks, landmarks))
    good = values > 1e-4
    half = (axes[:, good] / np.sqrt(values[good])) @ axes[:, good].T
    w = fitted(kernel(words, landmarks) @ half, y, weight, 0.05, "hinge")
    beta = half @ w[1:]
    folded = np.zeros(FEATURES, np.float32)
    for b, v in zip(beta, vectors(landmarks)):
        folded[list(v)] += b * np.array(list(v.values()), np.float32)
    return Machine(folded, float(w[0]), np.zeros(4))


def document_features(docs: DataFrame, machine: Machine, text: str) -> DataFrame:
    """`docs` with best, second and number of each text appended."""
    names = ("best", "second", "number")
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in names), *(f"{n} double" for n in names)])
    schema, sent = arrow_schema(ddl), docs.sparkSession.sparkContext.broadcast(machine)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(sent.value)
        for batch, texts in text_slices(batches, text):
            parts = document_parts(texts, scores)
            yield with_columns(batch, schema, {n: pa.array(parts[:, i]) for i, n in enumerate(names)}, drop=names)

    return docs.mapInArrow(task, ddl)


def score(docs: DataFrame, machine: Machine, text: str = "text", to: str = "score") -> DataFrame:
    """`docs` with the score of each text as column `to`."""
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != to), f"`{to}` double"])
    schema, sent = arrow_schema(ddl), docs.sparkSession.sparkContext.broadcast(machine)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        scores = _Scores(machine)
        for batch, texts in text_slices(batches, text):
            yield with_columns(batch, schema, {to: pa.array(machine.document(document_parts(texts, scores)))}, drop=(to,))

    return docs.mapInArrow(task, ddl)
