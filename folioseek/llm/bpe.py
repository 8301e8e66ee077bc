"""Operator 5: byte-pair encoding and decoding with a contiguous rank array per short word.

A text is cut at ASCII white space, each run into pieces by the tokenizer file's own pattern, and each
piece is merged on its own: its part boundaries and the merge ranks of adjacent parts lie in two lists;
the least rank is found by scanning, its boundary deleted, and only the neighbouring ranks are refreshed.
Pieces never reach over white space, so the ids of a run depend on the run alone and are kept in a
bounded memo per task. The file's path is a parameter; nothing of it is copied.

Nulls count as empty texts, and an empty text has no ids, the empty decoding, and the digests of
the empty string. Texts of any length are encoded whole; rows are independent, so repeated rows give
repeated results and empty tables empty ones. A piece of n bytes costs n scans of its rank list,
except that pieces longer than LONG_PIECE keep the ranks in a heap with the same order of merges.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioseek.llm.common import Memo, arrow_schema, text_slices, with_columns

LONG_PIECE = 200
NO_RANK = 1 << 60
#: Bytes of special tokens, and of U+0300 to U+036F, which compose otherwise with small letters.
EARLY = (b"<", b"\xcc", b"\xcd")

RESULTS = {
    "n_tokens": "long",
    "ids": "array<int>",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def byte_letters() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class RankedVocabulary:
    """Vocabulary, merge ranks and splitting pattern of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pieces = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        # pair of parts (ids) -> rank; rank -> id of the merged part
        self.pairs: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[self.vocab[left], self.vocab[right]] = rank
            self.merged.append(self.vocab[left + right])
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in pieces if p["type"] == "Split"))
        self.marked = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        parts = [self.inner[b] for b in piece[:-1]]
        parts.append(self.last[piece[-1]])
        pairs = self.pairs
        if len(parts) > LONG_PIECE:
            return self._merge_long(parts)
        rank_of, merged = pairs.get, self.merged
        ranks = list(map(rank_of, zip(parts, parts[1:]), repeat(NO_RANK)))
        while ranks and (least := min(ranks)) != NO_RANK:
            at = ranks.index(least)
            parts[at] = new = merged[least]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of((new, parts[at + 1]), NO_RANK)
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], new), NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for a long piece: least rank first, leftmost among equals."""
        n, pairs = len(parts), self.pairs
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(pairs[x], i, x) for i, x in enumerate(zip(parts, parts[1:])) if x in pairs]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i], alive[j], after[i] = self.merged[rank], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (pair := (parts[a], parts[b])) in pairs:
                    heapq.heappush(heap, (pairs[pair], a, pair))
        return [p for p, on in zip(parts, alive) if on]

    def run_ids(self, run: bytes) -> list[int]:
        """Ids of a run without ASCII white space."""
        text, ids = run.decode("utf-8", "replace"), []
        for part in self.marked.split(text) if self.marked and "<" in text else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            normal = "".join(c.lower() for c in unicodedata.normalize("NFC", part)) if not part.isascii() else part.lower()
            for piece in self.pattern.findall(normal):
                ids += self.merge(piece.encode())
        return ids

    def runs(self, text: bytes) -> list[bytes]:
        """The runs of a text; with A-Z in lower case at once, unless special tokens or combining marks may be there."""
        return (text if any(x in text for x in EARLY) else text.lower()).split()

    def encode(self, text: str) -> list[int]:
        return [i for run in self.runs(text.encode()) for i in self.run_ids(run)]

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts joined by one space, special ones kept, as the file has no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class _Runs(Memo):
    """run -> (number of ids, decimal ids, decoded tokens), the last two joined by spaces."""

    def __init__(self, words: RankedVocabulary, limit: int):
        super().__init__(limit)
        self.words = words

    def __missing__(self, run: bytes) -> tuple[int, bytes, str]:
        ids = self.words.run_ids(run)
        self[run] = value = (len(ids), " ".join(map(str, ids)).encode(), self.words.decode(ids))
        return value


def bpe_encode(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    results: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    memo_runs: int = 250_000,
) -> DataFrame:
    """`docs` with the named RESULTS appended (columns of `docs` that have such a name are replaced).

    `ids` are the ids of the whole text, `decoded` the text that they decode to; the digests are
    of the ids as decimals joined by one space, and of `decoded` in UTF-8.
    """
    unknown = [r for r in results if r not in RESULTS]
    if unknown:
        raise ValueError(f"unknown results: {unknown}")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in results]
    ddl = ", ".join([*kept, *(f"{r} {RESULTS[r]}" for r in results)])
    source = docs
    hidden = "__text__"
    while hidden in docs.columns:
        hidden += "_"
    source = docs.withColumn(hidden, docs[text].cast("binary"))
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = RankedVocabulary(tokenizer_path)
        memo = _Runs(words, memo_runs)
        for batch, texts in text_slices(batches, hidden):
            out: dict[str, list] = {r: [] for r in results}
            for t in texts:
                runs = words.runs(t or b"")
                memo.room(min(len(runs), memo_runs // 2))
                found = [f for f in map(memo.__getitem__, runs) if f[0]]
                decimals = b" ".join([f[1] for f in found])
                decoded = " ".join([f[2] for f in found])
                for r in results:
                    if r == "n_tokens":
                        x = sum([f[0] for f in found])
                    elif r == "ids":
                        x = [int(i) for i in decimals.split()]
                    elif r == "decoded":
                        x = decoded
                    else:
                        x = hashlib.sha256(decimals if r == "ids_sha256" else decoded.encode()).hexdigest()
                    out[r].append(x)
            yield with_columns(batch, schema, out, drop=(hidden, *results))

    return source.mapInArrow(task, ddl)


def bpe_decode(docs: DataFrame, tokenizer_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """`docs` with the text of the id lists in column `ids` as column `to`; null lists decode to null."""
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != to), f"`{to}` string"])
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = RankedVocabulary(tokenizer_path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            new = [None if x is None else words.decode(x) for x in lists]
            yield with_columns(batch, schema, {to: new}, drop=(to,))

    return docs.mapInArrow(task, ddl)
