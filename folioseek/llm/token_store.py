"""Operator 2: token ids as raw binary shards with a minimal perfect hash index over the document keys.

Files, all little-endian, in one folder of a store that every executor reaches (local path, or a URI
that `pyarrow.fs` opens):

* `shard-*.ids`   raw ids of the shard's documents one after the other, 2 bytes each (4 where the
                  vocabulary needs it), the end id after each document
* `shard-*.off`   n + 1 unsigned 64-bit counts: where each document starts in the shard, in ids
* `index-*.mph`   one file per hash bucket of keys: a minimal perfect hash (levels of bit arrays; a key's slot is
                  the rank of its bit) and per slot a stored 32-bit fingerprint, shard, first document and count

A keyed read is: bucket of the key, its bit in the first level where it is alone, rank, one slot, one
fingerprint comparison. Keys that were never stored are told by a missing bit or by the fingerprint.

Documents are in ascending key order (null first; repeated keys lie together, shorter reads of equal
keys in text order). A key that occurs n times has one slot with count n. Null texts are empty; each
document has at least the end id. An empty table has no shards and no index. Every attempt of a task
writes files of its own name and only the manifest of committed tasks names them.
"""
from __future__ import annotations

import json
import math
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioseek.llm.bpe import byte_letters
from folioseek.llm.common import Memo, Scratch

MAGIC = b"MPHIDX1\n"
#: The splitting pattern that `piece_starts` states for plain texts, and its endings behind an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
KNOWN_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The key that stands for null; it is no document id.
NULL_KEY = -(1 << 63)
#: Bits per remaining key in each level of the hash.
GAMMA = 2


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1001) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit keys -> 0 .. n-1, without the keys themselves.

    Level by level, each remaining key marks one bit; bits marked once are set and their keys are
    done. The slot of a key is the number of set bits before its own, over all levels.
    """

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys.astype(np.int64)
        while len(left):
            size = -(-GAMMA * len(left) // 64) * 64
            at = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            bits = hits == 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~bits[at]]
            if len(sizes) > 200:
                raise ValueError("keys of a perfect hash must be distinct")
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some of the keys that were not built in."""
        keys = keys.astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = (mixed(keys[rest], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            w, b = word[found], bit[found]
            below = self.words[w] & ((np.uint64(1) << b) - np.uint64(1))
            out[rest[found]] = self.before[w] + np.bitwise_count(below)
            rest = rest[~found]
        return out


SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("first", "<u4"), ("count", "<u4")])


def index_bytes(keys: np.ndarray, shard: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    """One index file."""
    mph = PerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    at = mph.slots(keys)
    for name, values in (("fingerprint", fingerprints(keys)), ("shard", shard), ("first", first), ("count", count)):
        slots[name][at] = values
    head = struct.pack(f"<II{len(mph.sizes)}Q", len(mph.sizes), len(keys), *mph.sizes)
    return MAGIC + head + mph.words.astype("<u8").tobytes() + slots.tobytes()


class IndexFile:
    """An index file in memory: keys -> (shard, first document, count), count 0 for unknown keys."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not an index file")
        n_levels, n = struct.unpack_from("<II", data, len(MAGIC))
        at = len(MAGIC) + 8
        sizes = list(struct.unpack_from(f"<{n_levels}Q", data, at))
        at += 8 * n_levels
        n_words = sum(sizes) // 64
        self.mph = PerfectHash(sizes, np.frombuffer(data, "<u8", n_words, at))
        self.slots = np.frombuffer(data, SLOT, n, at + 8 * n_words)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), SLOT)
        at = self.mph.slots(keys)
        known = np.flatnonzero(at >= 0)
        hit = self.slots[at[known]]
        same = hit["fingerprint"] == fingerprints(keys[known])
        out[known[same]] = hit[same]
        return out


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


#: Texts of these characters (ASCII and Latin letters that no normal form changes) can be cut here as the tokenizer cuts them.
LATIN = "\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
PLAIN = re.compile(rf"[\t-\r !-;=-~{LATIN}]*")  # no "<", which special tokens begin with
#: What a byte of a plain text in small letters is: white space, part of a letter, a digit, anything else.
BLANK, LETTER, DIGIT, OTHER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[list(b"\t\n\v\f\r ")] = BLANK
KIND[ord("a") : ord("z") + 1] = KIND[128:] = LETTER
KIND[ord("0") : ord("9") + 1] = DIGIT
#: Bytes of text whose distinct pieces are looked up together (a longer single text goes alone).
SLICE_BYTES = 8 << 20


def piece_starts(low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which bytes of plain texts in small letters begin a piece; `starts` are the first bytes of the texts.

    Pieces are runs of letters, single digits, runs of anything else but white space, and the ENDINGS behind an
    apostrophe that begins such a run.
    """
    kind = KIND[low]
    begin = kind != BLANK
    solid = begin.copy()
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begin[starts] = solid[starts]
    edge = np.zeros(len(low) + 3, bool)  # no ending goes on in the next text
    edge[starts] = edge[len(low) :] = True
    apostrophe = np.flatnonzero((low == ord("'")) & begin)
    padded = np.append(low, np.zeros(3, np.uint8))
    second, third = padded[apostrophe + 1], padded[apostrophe + 2]
    size = np.zeros(len(apostrophe), np.int64)
    for ending in ENDINGS:
        same = (second == ord(ending[0])) & ~edge[apostrophe + 1]
        if len(ending) == 2:
            same &= (third == ord(ending[1])) & ~edge[apostrophe + 2]
        size[same] = len(ending) + 1
    apostrophe, size = apostrophe[size > 0], size[size > 0]
    begin[apostrophe + 1] = False
    after = (apostrophe + size)[apostrophe + size < len(low)]
    begin[after] = solid[after]
    return begin


class _LibraryPieces(Memo):
    """piece of text in UTF-8 -> its ids as raw bytes, from the tokenizers library's model."""

    def __init__(self, path: str, dtype: str, limit: int):
        super().__init__(limit)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.dtype, self.code = dtype, "H" if dtype == "<u2" else "I"
        with open(path, encoding="utf-8") as f:
            cuts = json.load(f)["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex", "")
        self.known = cuts == KNOWN_CUTS  # another file's texts all go through the chain
        self.letters = byte_letters()

    def __missing__(self, piece: bytes) -> bytes:
        self.room(1)
        mapped = piece.decode() if piece.isascii() else "".join([self.letters[b] for b in piece])
        self[piece] = ids = array(self.code, [t.id for t in self.tokenize(mapped)]).tobytes()
        return ids

    def is_plain(self, text: bytes) -> bool:
        return self.known and PLAIN.fullmatch(text.decode("utf-8", "replace")) is not None

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts one after the other, and where each text's begin and end."""
        data, offsets = _bytes_of(texts)
        if self.is_plain(data.tobytes()):
            return self._plain(data, offsets)
        values = texts.to_pylist()
        odd = {i for i, t in enumerate(values) if t and not self.is_plain(t)}
        ids, bounds = self._plain(*_bytes_of(pa.array([b"" if i in odd else t for i, t in enumerate(values)], pa.binary())))
        parts = [self._mixed(values[i]) if i in odd else part for i, part in enumerate(np.split(ids, bounds[1:-1]))]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Plain texts: their distinct pieces are looked up once."""
        low = np.frombuffer(data.tobytes().decode().lower().encode(), np.uint8)  # no letter of these changes its length
        begin = piece_starts(low, offsets[:-1][offsets[:-1] < offsets[1:]])
        solid = KIND[low] != BLANK
        at = np.flatnonzero(begin)
        place = np.cumsum(solid, dtype=np.int32)
        bounds = np.append(place[at] - 1, place[-1:]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(low[solid])]).dictionary_encode()
        found = list(map(self.__getitem__, words.dictionary.to_pylist()))
        known = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.dtype).itemsize
        which = words.indices.to_numpy()
        counts = sizes[which]
        upto = np.concatenate([[0], np.cumsum(counts)])
        first = (np.cumsum(sizes) - sizes)[which] - upto[:-1]
        ids = known[np.repeat(first, counts) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(at, offsets)]

    def _mixed(self, text: bytes) -> np.ndarray:
        """One text by its runs between ASCII white space: plain runs as above, others through the library's whole chain."""
        runs = text.split()
        plain = [self.is_plain(run) for run in runs]
        other = [run.decode("utf-8", "replace") for run, p in zip(runs, plain) if not p]
        chain = iter(self.tokenizer.encode_batch_fast(other, add_special_tokens=False))
        ids, bounds = self._plain(*_bytes_of(pa.array([run if p else b"" for run, p in zip(runs, plain)], pa.binary())))
        parts = np.split(ids, bounds[1:-1])
        return np.concatenate([part if p else np.array(next(chain).ids, self.dtype) for part, p in zip(parts, plain)])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array and its n + 1 offsets in them; nulls are empty."""
    texts = texts.fill_null(b"").cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most SLICE_BYTES of `column`, or of one row."""
    for batch in batches:
        upto = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + SLICE_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end


_KEPT: dict[tuple, _LibraryPieces] = {}


def kept_pieces(path: str, dtype: str, limit: int) -> _LibraryPieces:
    """The memo of this Python worker: Spark hands workers on from task to task, and pieces learnt once stay known."""
    file = os.stat(path)
    key = (path, file.st_mtime_ns, file.st_size, dtype, limit)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = _LibraryPieces(path, dtype, limit)
    return _KEPT[key]


@dataclass
class TokenStore:
    """The committed files of one run."""

    folder: str
    width: int  # bytes per id
    shards: DataFrame  # shard, ids_file, off_file, n_docs, n_ids
    index: DataFrame  # bucket, file, n_keys
    n_buckets: int


def key_column(name: str):
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_KEY))


def bucket_column(n: int):
    return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    shard_bytes: int = 32 << 20,
    bucket_keys: int = 200_000,
    memo_pieces: int = 800_000,
) -> TokenStore:
    """Encode every whole text and write shards of about `shard_bytes` of text, then the index.

    Texts are encoded piece by piece: the tokenizer's normaliser and pattern never join characters over white space,
    so a text's ids are those of its pieces in turn. A task looks the distinct pieces of SLICE_BYTES of text up at
    once; the memo's bound is of pieces per Python worker.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    rows = docs.select(key_column(key).alias("key"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.length("text") + 16).alias("n")).first()["n"] or 0
    n_shards = max(1, math.ceil(size / shard_bytes))
    ordered = rows.repartitionByRange(n_shards, "key").sortWithinPartitions("key", "text")
    vocabulary = _LibraryPieces(tokenizer_path, "<u4", 16).tokenizer.get_vocab_size()
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    dtype = f"<u{width}"
    store, base = opened(folder)
    store.create_dir(base, recursive=True)

    def shard_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_pieces(tokenizer_path, dtype, memo_pieces)
        shard, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"shard-{shard:07d}-{mark}.{x}" for x in ("ids", "off")]
        fs, path = opened(folder)
        starts, at = [0], 0
        keys, firsts, counts = [], [], []
        out = None
        for batch in _slices(batches, 1):
            if out is None:
                out = fs.open_output_stream(f"{path}/{names[0]}")
            ids, bounds = pieces.encode(batch.column(1))
            out.write(np.insert(ids, bounds[1:], end_id).tobytes())
            starts += (at + bounds[1:] + np.arange(1, len(bounds))).tolist()
            at = starts[-1]
            for n, k in enumerate(batch.column(0).to_pylist(), len(starts) - 1 - batch.num_rows):
                if keys and keys[-1] == k:
                    counts[-1] += 1
                else:
                    keys.append(k), firsts.append(n), counts.append(1)
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{path}/{names[1]}") as f:
            f.write(np.array(starts, "<u8").tobytes())
        step = 50_000
        for i in range(0, len(keys), step):  # the first row also names the files
            k = keys[i : i + step]
            first = [None] * len(k)
            columns = [k, [shard] * len(k), firsts[i : i + step], counts[i : i + step], *([list(first) for _ in range(4)])]
            if not i:
                for c, value in zip(columns[4:], (*names, len(starts) - 1, at)):
                    c[0] = value
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            labels = ("key", "shard", "first", "count", "ids_file", "off_file", "n_docs", "n_ids")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=labels)

    ddl = "key long, shard int, first long, count long, ids_file string, off_file string, n_docs long, n_ids long"
    entries = scratch.table(ordered.mapInArrow(shard_task, ddl), "entries")
    shards = scratch.table(
        entries.where("ids_file is not null").select("shard", "ids_file", "off_file", "n_docs", "n_ids"), "shards", lasting=True
    )
    n_buckets = max(1, math.ceil(entries.count() / bucket_keys))

    def index_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        for bucket, rows in grouped(batches, "bucket"):
            name = f"index-{bucket:07d}-{uuid.uuid4().hex}.mph"
            data = index_bytes(*(rows[c] for c in ("key", "shard", "first", "count")))
            with fs.open_output_stream(f"{path}/{name}") as f:
                f.write(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([name]), pa.array([len(rows["key"])], pa.int64())],
                names=["bucket", "file", "n_keys"],
            )

    keyed = entries.select(bucket_column(n_buckets).alias("bucket"), "key", "shard", "first", "count")
    index = keyed.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "key")
    written = scratch.table(index.mapInArrow(index_task, "bucket int, file string, n_keys long"), "index", lasting=True)
    scratch.drop()
    return TokenStore(folder, width, shards, written, n_buckets)


def grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Runs of equal `by` in sorted numeric batches, as whole numpy columns."""
    now, parts = None, []
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(by)).to_numpy()
        edges = np.flatnonzero(np.diff(values)) + 1
        for a, b in zip([0, *edges], [*edges, len(values)]):
            if b == a:
                continue
            if now is not None and values[a] != now:
                yield now, _stacked(parts)
                parts = []
            now = int(values[a])
            parts.append(batch.slice(a, b - a))
    if parts:
        yield now, _stacked(parts)


def _stacked(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(parts)
    return {n: table.column(n).to_numpy() for n in table.column_names}


def find_keys(store: TokenStore, keys: DataFrame) -> DataFrame:
    """(key, shard, first, count) of the keys in column `key`, by the index; unknown keys have count 0."""
    spark, folder, n = keys.sparkSession, store.folder, store.n_buckets
    # one row per index file: at most one per `bucket_keys` keys
    files = spark.sparkContext.broadcast({r["bucket"]: r["file"] for r in store.index.collect()})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        have, loaded = None, None
        for batch in batches:
            values, bucket = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            out = np.zeros(len(values), SLOT)
            for b in np.unique(bucket):
                if b != have:
                    name = files.value.get(int(b))
                    loaded = IndexFile(fs.open_input_file(f"{path}/{name}").readall()) if name else None
                    have = b
                mine = np.flatnonzero(bucket == b)
                if loaded is not None:
                    out[mine] = loaded.find(values[mine])
            yield pa.RecordBatch.from_arrays(
                [pa.array(values), *(pa.array(out[c].astype(np.int64)) for c in ("shard", "first", "count"))],
                names=["key", "shard", "first", "count"],
            )

    dealt = keys.select(bucket_column(n).alias("bucket"), "key").repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(task, "key long, shard long, first long, count long")


def read_tokens(store: TokenStore, found: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document behind `found` (rows of `find_keys`), from the payloads.

    start counts the ids of all documents before it in the whole store.
    """
    spark, folder, width = found.sparkSession, store.folder, store.width
    at, bases = 0, {}
    for r in store.shards.orderBy("shard").collect():  # one row per shard file
        bases[r["shard"]] = (at, r["ids_file"], r["off_file"])
        at += r["n_ids"]
    files = spark.sparkContext.broadcast(bases)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        have, starts, payload, base = None, None, None, 0
        for batch in batches:
            keys, firsts, starts_out, sizes, crcs = [], [], [], [], []
            for key, shard, first, count in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if shard != have:
                    base, ids_file, off_file = files.value[shard]
                    starts = np.frombuffer(fs.open_input_file(f"{path}/{off_file}").readall(), "<u8")
                    payload, have = fs.open_input_file(f"{path}/{ids_file}"), shard
                for d in range(first, first + count):
                    a, b = int(starts[d]), int(starts[d + 1])
                    raw = payload.read_at((b - a) * width, a * width)
                    ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                    keys.append(None if key == NULL_KEY else key)
                    starts_out.append(base + a), sizes.append(b - a), crcs.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (keys, starts_out, sizes, crcs)],
                names=["key", "start", "n_tokens", "ids_crc32"],
            )

    n = max(1, len(bases))
    located = found.where("count > 0").repartition(n, "shard").sortWithinPartitions("shard", "first")
    return located.mapInArrow(task, "key long, start long, n_tokens long, ids_crc32 long")
