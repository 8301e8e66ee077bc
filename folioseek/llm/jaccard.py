"""Operator 8: all links of Jaccard similarity >= 80 % on 5-word shingles, under several global token orders.

A document is the set of its distinct shingles (64-bit hashes of 5 words; A-Z as a-z; words are runs without ASCII
white space; with fewer than 5 words, all of them are one shingle). Equal sets are one *node*. Sets of n and
m shingles that link share at least o = ceil(4 (n + m) / 9), so that, whatever the global order of shingles, they share one
among the first n - o + 1 of the one and the first m - o + 1 of the other. The orders used here agree on classes
and differ within them:

* class 0, shingles that only one document has; 1, others; 2, common ones; in each class by another hash per order.
  Classes come from a count of shingles into bitmaps of fixed size, and too high a class only costs time: an
  order is an order. A document with a whole prefix in class 0 can have no partner.
* candidates come from an index on the prefix of the first order (class 0 left out), and must share a prefix
  shingle under each further order too, before the whole sets are compared.

Large groups never become all pairs. In each turn a node is compared with one leader: of the leaders
of its index lists, the one that it shares most lists with; links join components. A list is led by a
node with few shingles of its own, which an original is to its near copies, and by others in later turns. When a turn
joins few of its pairs, the rest, nodes of different components on one list, is compared pair by pair, but for
pairs compared before, so that no link between components is lost and the components are exact.

Null and empty texts have the empty set: n_shingles 0, linked with nothing. Repeated rows are copies:
one node. Repeated document ids are separate rows; null ids are ignored as component ids while
another id is in the component. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioseek.llm.common import Memo, Scratch, arrow_schema, text_slices, with_columns

SHINGLE = 5
#: Bits of the two bitmaps (shared, common): 16 MB each, whatever the input.
BITMAP_BITS = 27
COMMON_DOCS = 32
SLICES = 64  # ranges of hashes that are counted on their own
NODE_BITS = 24  # of the bitmap of nodes, 2 MB
HELD = 2_000_000  # shingles that a task holds before it hands their counts on
#: Pairs of one leader that are compared beside one repeat of its set.
LEADER_PAIRS = 256
#: A turn that joins less than this share of its pairs is the last.
WORTH_A_TURN = 0.1
ORDERS = (0, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
FACTORS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0x9E3779B185EBCA87)


class WordHashes(Memo):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words."""
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        out = h[:n] * np.uint64(FACTORS[0])
        for i in range(1, width):
            out += h[i : i + n] * np.uint64(FACTORS[i])
        return mixed(out + np.uint64(width))


def shingle_sets(texts: list[bytes | None], memo: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words and windows are hashed for all texts at once."""
    split = [t.lower().split() if t else [] for t in texts]
    sizes = list(map(len, split))
    h = np.empty(sum(sizes), np.uint64)
    at = 0
    for words in split:
        for i in range(0, len(words), memo.limit // 2):
            part = words[i : i + memo.limit // 2]
            memo.room(len(part))
            h[at : at + len(part)] = np.fromiter(map(memo.__getitem__, part), np.uint64, len(part))
            at += len(part)
    full = windows(h, SHINGLE) if len(h) >= SHINGLE else h[:0]
    out, at = [], 0
    for n in sizes:
        s = full[at : at + n - SHINGLE + 1].copy() if n >= SHINGLE else windows(h[at : at + n], n) if n else h[:0]
        if len(s) > 1:
            s.sort()
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        out.append(s)
        at += n
    return out


def node_of(s: np.ndarray) -> int:
    x = xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))
    return x - (1 << 64) if x >> 63 else x


def prefix_size(n: int) -> int:
    """Places of the longest prefix that a partner of any size can ask for."""
    return n - (8 * n + 9) // 10 + 1


class Classes:
    """The class of shingles, by the two bitmaps."""

    def __init__(self, shared: np.ndarray, common: np.ndarray):
        self.shared, self.common = shared, common

    def of(self, s: np.ndarray) -> np.ndarray:
        at = (s >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
        bit, at = np.uint8(1) << (at & 7).astype(np.uint8), at >> 3
        return ((self.shared[at] & bit) > 0).astype(np.uint64) + ((self.common[at] & bit) > 0)

    @staticmethod
    def prefix(s: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
        """The prefix under one order from the first shingle beyond class 0 on, in order."""
        rank = s if not order else mixed(s ^ np.uint64(order))
        key = (classes << np.uint64(62)) | (rank >> np.uint64(2))
        k = prefix_size(len(s))
        chosen = np.argpartition(key, k - 1)[:k] if k < len(s) else np.arange(len(s))
        chosen = chosen[np.argsort(key[chosen])]
        return s[chosen[classes[chosen] > 0]]


def packed(x: np.ndarray, low: int) -> bytes:
    """Sorted 32-bit values from `low` on as 16-bit steps; 65535 is a step without a value."""
    steps = np.diff(x.astype(np.int64), prepend=low)
    skips = steps // 65535
    at = np.arange(len(x)) + np.cumsum(skips)
    out = np.full(int(at[-1]) + 1 if len(x) else 0, 65535, np.uint16)
    out[at] = steps % 65535
    return out.tobytes()


def unpacked(data: bytes, low: int) -> np.ndarray:
    steps = np.frombuffer(data, np.uint16)
    return (np.cumsum(steps, dtype=np.int64) + low)[steps != 65535]


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """(slice, counted): the top 32 bits of the shingles of all documents, once per task and node, by ranges."""
    schema = arrow_schema("slice int, counted binary")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, held = WordHashes(), Memo(200_000), []

        def parts() -> pa.RecordBatch:
            x = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
            lows = [(i << 32) // SLICES for i in range(SLICES + 1)]
            edges = np.searchsorted(x, lows)
            cut = [(i, packed(x[a:b], lows[i])) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([c[k] for c in cut], schema[k].type) for k in range(2)], schema=schema)

        for _, texts in text_slices(batches, "text"):
            for s in shingle_sets(texts, memo):
                node = node_of(s)
                seen.room(1)
                if node not in seen:  # copies would make all their shingles look shared
                    seen[node] = True
                    held.append((s >> np.uint64(32)).astype(np.uint32))
            if sum(map(len, held)) > HELD:
                yield parts()
                held.clear()
        if held:
            yield parts()

    return docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(task, "slice int, counted binary")


def _bitmaps(counted: DataFrame) -> Classes:
    """Bitmaps of the shingles in two documents or more, and in COMMON_DOCS or more; of fixed size whatever the input."""
    size = (1 << BITMAP_BITS) // SLICES // 8  # bytes of a slice's bitmap

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, x in _by_slice(batches):
            low, bits = (i << 32) // SLICES, []
            for least in (2, COMMON_DOCS):
                many = x[least - 1 :][x[least - 1 :] == x[: len(x) - least + 1]] if len(x) >= least else x[:0]
                flags = np.zeros(size * 8, bool)
                flags[(many - low) >> (32 - BITMAP_BITS)] = True
                bits.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([b], pa.binary()) for b in bits)], names=["slice", "shared", "common"])

    dealt = counted.repartition(SLICES, "slice").sortWithinPartitions("slice")
    whole = [np.zeros(SLICES * size, np.uint8) for _ in range(2)]
    for r in dealt.mapInArrow(task, "slice int, shared binary, common binary").collect():
        for bitmap, name in zip(whole, ("shared", "common")):
            bitmap[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r[name], np.uint8)
    return Classes(*whole)


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted values of each slice."""
    now, parts = None, []
    for batch in batches:
        for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i != now and parts:
                yield now, np.sort(np.concatenate(parts))
                parts = []
            now = i
            parts.append(unpacked(blob, (i << 32) // SLICES))
    if parts:
        yield now, np.sort(np.concatenate(parts))


FOUND = "n0 int, own double, prefix array<long>"
SET = "node long, n int, n0 int, further array<binary>, shingles binary"


def _scanned(docs: DataFrame, key: str, text: str, classes: Broadcast) -> DataFrame:
    """Per document: key, n, node; where it may have partners and is the first of its node in the task also FOUND.

    n0: shingles of class 0 before the prefix; own: their share; prefix: the prefix of the first order, in order.
    """
    ddl = f"key {docs.schema[key].dataType.simpleString()}, n int, node long, {FOUND}"
    schema = arrow_schema(ddl)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = WordHashes(), Memo(200_000)
        for batch, texts in text_slices(batches, "text"):
            found = []
            for s in shingle_sets(texts, memo):
                node, extra = node_of(s), (None,) * 3
                seen.room(1)
                if len(s) and node not in seen:
                    seen[node] = True
                    of = classes.value.of(s)
                    first = classes.value.prefix(s, of, ORDERS[0])
                    if len(first):
                        n0 = int((of == 0).sum())
                        extra = (n0, n0 / len(s), first.view(np.int64))
                found.append((len(s), node, *extra))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found), list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema[0].type), *columns], schema=schema)

    return rows.mapInArrow(task, ddl)


def _node_bits(nodes: DataFrame) -> np.ndarray:
    """A bitmap of the nodes, of fixed size whatever their number."""
    size = (1 << NODE_BITS) // SLICES

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict[int, np.ndarray] = {}
        for batch in batches:
            at = bit_of(batch.column(0).to_numpy())
            for i in np.unique(at // size):
                flags.setdefault(int(i), np.zeros(size, bool))[at[at // size == i] - i * size] = True
        bits = [np.packbits(x, bitorder="little").tobytes() for x in flags.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(flags), pa.int32()), pa.array(bits, pa.binary())], names=["slice", "bits"])

    of = F.shiftrightunsigned("node", 64 - NODE_BITS) / size
    dealt = nodes.select("node", F.floor(of).cast("int").alias("slice")).repartition(SLICES, "slice").select("node")
    whole = np.zeros((1 << NODE_BITS) // 8, np.uint8)
    for r in dealt.mapInArrow(bitmap, "slice int, bits binary").collect():
        whole[r["slice"] * size // 8 : (r["slice"] + 1) * size // 8] |= np.frombuffer(r["bits"], np.uint8)
    return whole


def bit_of(nodes: np.ndarray) -> np.ndarray:
    return (nodes.view(np.uint64) >> np.uint64(64 - NODE_BITS)).astype(np.int64)


def _sets(docs: DataFrame, text: str, classes: Broadcast, nodes: DataFrame) -> DataFrame:
    """SET of the nodes: the further prefixes and the set itself, from a second reading of the texts.

    Sets take as much room as the texts. Only those of nodes that share a list are made, so that none is written in vain.
    """
    schema, sent = arrow_schema(SET), docs.sparkSession.sparkContext.broadcast(_node_bits(nodes))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, bits = WordHashes(), Memo(200_000), sent.value
        for _, texts in text_slices(batches, "text"):
            found = []
            for s in shingle_sets(texts, memo):
                node = node_of(s)
                at = int(bit_of(np.array([node], np.int64))[0])
                if not len(s) or not bits[at >> 3] >> (at & 7) & 1:
                    continue
                seen.room(1)
                if node not in seen:
                    seen[node] = True
                    of = classes.value.of(s)
                    further = [classes.value.prefix(s, of, o).tobytes() for o in ORDERS[1:]]
                    found.append((node, len(s), int((of == 0).sum()), further, s.tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    made = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(task, SET)
    return made.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _similar(scratch: Scratch, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (node, leader) that link: further orders first, and the whole sets of the pairs that are left."""
    near = scratch.table(_checked(pairs, sets, ("n", "n0", "further"), shares_prefixes), "near")
    scratch.release()
    return _checked(near, sets, ("shingles",), linked)


def _checked(pairs: DataFrame, sets: DataFrame, columns: tuple[str, ...], check: Callable) -> DataFrame:
    """The pairs whose `columns` of both sides pass the check.

    A leader's row is repeated once per LEADER_PAIRS of its pairs, which are dealt to the repeats, so
    that no task gets all pairs of a leader.
    """
    loads = pairs.groupBy("leader").agg(F.ceil(F.count("*") / LEADER_PAIRS).cast("int").alias("repeats"))
    dealt = pairs.join(loads, "leader").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("repeats")).cast("int"))
    left = dealt.join(sets, "node").select("node", "leader", "salt", *(F.col(c).alias(f"{c}_a") for c in columns))
    right = loads.join(sets.withColumnRenamed("node", "leader"), "leader").select(
        "leader", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("salt"), *(F.col(c).alias(f"{c}_b") for c in columns)
    )
    both = left.join(right, ["leader", "salt"]).select("node", "leader", *(f"{c}_{x}" for x in "ab" for c in columns))
    k = len(columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [check(a[:k], a[k:]) for a in zip(*([x.as_py() for x in batch.column(2 + i)] for i in range(2 * k)))]
            ends = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["node", "leader"])
            yield ends.filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(task, "node long, leader long")


def shares_prefixes(a: tuple[int, int, list[bytes]], b: tuple[int, int, list[bytes]]) -> bool:
    """Of (n, n0, further prefixes): a common shingle in each of them."""
    least = -(-4 * (a[0] + b[0]) // 9)
    for x, y in zip(a[2], b[2]):
        x, y = (np.frombuffer(p, np.uint64)[: max(0, s[0] - least + 1 - s[1])] for p, s in ((x, a), (y, b)))
        if not len(np.intersect1d(x, y, assume_unique=True)):
            return False
    return True


def linked(a: tuple[bytes], b: tuple[bytes]) -> bool:
    """Of two sets: the similarity itself."""
    common = len(np.intersect1d(np.frombuffer(a[0], np.uint64), np.frombuffer(b[0], np.uint64), assume_unique=True))
    return 100 * common >= 80 * ((len(a[0]) + len(b[0])) // 8 - common)


def fits(n: str, m: str, at: str, other: str) -> Column:
    """Sizes n and m can link, and the shared shingle is early enough in both (places `at` and `other`)."""
    least = F.ceil((F.col(n) + F.col(m)) * 4 / 9)
    return (F.col(at) <= F.col(n) - least) & (F.col(other) <= F.col(m) - least)


def components(scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) joined by links (a, b) into the components of the smallest label.

    Each pass gives every component the smallest label that it is linked with and then follows labels to their
    ends, so that chains halve; both sides are aggregated before they are joined.
    """
    spark = labels.sparkSession
    a, b = (labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    edges = links.toDF("a", "b").join(a, "a").join(b, "b").where("ca <> cb").select("ca", "cb").distinct()
    edges = scratch.table(edges, "edges")
    moved: DataFrame | None = None
    while edges.limit(1).count():
        both = edges.union(edges.select("cb", "ca"))
        up = both.groupBy(F.col("ca").alias("comp")).agg(F.min("cb").alias("to"))
        up = scratch.table(up.select("comp", F.least("comp", "to").alias("to")), "up")
        while True:  # follow to the end
            nxt = up.alias("x").join(up.select(F.col("comp").alias("to"), F.col("to").alias("further")), "to", "left")
            nxt = scratch.table(nxt.select("comp", F.coalesce("further", "to").alias("next"), "to"), "up")
            changed = nxt.where("next <> to").limit(1).count()
            up = nxt.select("comp", F.col("next").alias("to"))
            if not changed:
                break
        if moved is None:
            moved = up
        else:
            step = up.select(F.col("comp").alias("to"), F.col("to").alias("further"))
            old = moved.join(step, "to", "left").select("comp", F.coalesce("further", "to").alias("to"))
            new = up.join(moved.select("comp"), "comp", "left_anti").select("comp", "to")
            moved = scratch.table(old.union(new), "moved")
        x, y = (up.select(F.col("comp").alias(c), F.col("to").alias(f"{c}_to")) for c in ("ca", "cb"))
        edges = edges.join(x, "ca").join(y, "cb").where("ca_to <> cb_to").select(F.col("ca_to").alias("ca"), F.col("cb_to").alias("cb"))
        edges = scratch.table(edges.distinct(), "edges")
    if moved is None:
        return labels
    out = labels.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return scratch.table(out, "labels")


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", turns: int = 12) -> DataFrame:
    """Per row of `docs`: `key`, n_shingles, component_id (smallest key reachable by links)."""
    rows = _row_components(docs, key, text, turns)
    some = rows.where("n > 0")
    smallest = some.groupBy("comp").agg(F.min("key").alias("component_id"))
    out = some.join(smallest, "comp").select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_shingles"), F.col("key").alias("component_id"))
    return out.union(empty)


def _row_components(docs: DataFrame, key: str, text: str, turns: int = 12) -> DataFrame:
    """Per row of `docs`: key, n, node, and comp, a node of the row's component (for rows without words, their own)."""
    spark: SparkSession = docs.sparkSession
    scratch, early = Scratch(spark, "jaccard"), Scratch(spark, "jaccard")
    classes = spark.sparkContext.broadcast(_bitmaps(_counted(docs, text)))
    early.release()
    scan = early.table(_scanned(docs, key, text, classes), "scan")
    members = scratch.table(scan.select("key", "n", "node"), "members", lasting=True)
    found = scan.where("prefix is not null")
    index = found.select("node", "n", "n0", "own", "prefix").dropDuplicates(["node"])
    index = index.select("node", "n", "own", "n0", F.posexplode("prefix").alias("at", "shingle"))
    index = early.table(index.withColumn("at", F.col("at") + F.col("n0")).drop("n0"), "index")
    lists = index.groupBy("shingle").agg(F.count("*").alias("size")).where("size > 1").select("shingle")
    index = scratch.table(index.join(lists, "shingle"), "index")
    labels = scratch.table(index.select("node", F.col("node").alias("comp")).distinct(), "labels")
    early.drop()
    early.release()
    sets = scratch.table(_sets(docs, text, classes, labels.select("node")), "sets")
    scratch.release()
    tried: DataFrame | None = None
    for turn in range(turns):
        rows = _open(scratch, index, labels)
        pairs = scratch.table(_leader_pairs(rows, tried, turn), "pairs")
        asked = pairs.count()
        scratch.release()
        if not asked:
            break
        links = scratch.table(_similar(scratch, pairs, sets), "links")
        tried = pairs if tried is None else scratch.table(tried.union(pairs), "tried")
        joined = links.count()
        labels = components(scratch, labels, links) if joined else labels
        if joined < asked * WORTH_A_TURN:
            break
    rest = scratch.table(_rest(_open(scratch, index, labels), tried), "rest")
    if rest.limit(1).count():
        labels = components(scratch, labels, scratch.table(_similar(scratch, rest, sets), "links"))
    labels = scratch.table(labels, "final", lasting=True)
    scratch.drop()
    return members.join(labels, "node", "left").select("key", "n", "node", F.coalesce("comp", "node").alias("comp"))


def _open(scratch: Scratch, index: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the index lists that still hold more than one component, with comp."""
    rows = index.join(labels, "node")
    several = rows.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle")
    return scratch.table(rows.join(several, "shingle").select("shingle", "node", "n", "own", "at", "comp"), "open")


def size_step(n: Column) -> Column:
    """Steps of 1.25: sizes that can link are in the same or in neighbouring steps."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25)) + 1e-9).cast("int")


def beside(step: Column) -> Column:
    return F.explode(F.array(step - 1, step, step + 1)).alias("step")


def _leader_pairs(rows: DataFrame, tried: DataFrame | None, turn: int) -> DataFrame:
    """For each node at most one leader (node, leader), of another component: the one that it shares most lists with.

    A list has one leader per size step: first the node with the least share of shingles of its own, then others.
    """
    rows = rows.withColumn("step", size_step(F.col("n")))
    chance = F.xxhash64("node", F.lit(turn))
    weight = F.struct("own", chance.alias("chance")) if turn == 0 else F.struct(chance.alias("chance"))
    first = rows.groupBy("shingle", "step").agg(F.min_by(F.struct("node", "n", "at", "comp"), weight).alias("l"))
    leaders = first.select("shingle", beside(F.col("step")), F.col("l.node").alias("leader"), F.col("l.n").alias("m"),
                           F.col("l.at").alias("place"), F.col("l.comp").alias("leader_comp"))
    pairs = rows.join(leaders, ["shingle", "step"]).where((F.col("comp") != F.col("leader_comp")) & fits("n", "m", "at", "place"))
    counts = pairs.groupBy("node", "leader").agg(F.count("*").alias("shared"))
    counts = counts if tried is None else _without(counts, tried)
    best = counts.groupBy("node").agg(F.max(F.struct("shared", "leader")).alias("p"))
    return best.select("node", "p.leader")


def _without(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """The pairs but for those compared before, either way round."""
    both = tried.union(tried.select("leader", "node"))
    return pairs.join(both, ["node", "leader"], "left_anti")


def _rest(rows: DataFrame, tried: DataFrame | None) -> DataFrame:
    """All pairs of different components on one list, but for those compared before.

    Most of a long list is one component by now. Its other members are joined with all; it is not joined with itself.
    """
    shares = rows.groupBy("shingle", "comp").agg(F.count("*").alias("size"))
    largest = shares.groupBy("shingle").agg(F.max_by("comp", F.struct("size", "comp")).alias("largest"))
    rows = rows.join(largest, "shingle")
    step = size_step(F.col("n"))
    left = rows.where("comp <> largest").select("shingle", "node", "n", "at", "comp", step.alias("step"))
    right = rows.select("shingle", F.col("node").alias("leader"), F.col("n").alias("m"), F.col("at").alias("place"),
                        F.col("comp").alias("leader_comp"), "largest", beside(step))
    once = (F.col("leader_comp") == F.col("largest")) | (F.col("node") < F.col("leader"))
    other = once & (F.col("comp") != F.col("leader_comp")) & fits("n", "m", "at", "place")
    pairs = left.join(right, ["shingle", "step"]).where(other).select("node", "leader").distinct()
    return pairs if tried is None else _without(pairs, tried)


def _with_nodes(docs: DataFrame, text: str, to: str) -> DataFrame:
    """`docs` with the node of each row's text as column `to`."""
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{to} long"])
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch, texts in text_slices(batches, text):
            yield with_columns(batch, schema, {to: [node_of(s) for s in shingle_sets(texts, memo)]})

    return docs.mapInArrow(task, ddl)


def first_of_each_component(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component (of its smallest key, then its least node), whole and with the columns of `docs`.

    Rows that repeat a key are judged by their own texts: a row goes only where another row of its own component stays.
    Of rows with equal key and equal set one stays, also of those without words. Rows with a null key, which nothing can name, are kept.
    """
    scratch = Scratch(docs.sparkSession, "first")
    found = scratch.table(_row_components(docs, key, text).where("key is not null"), "found", lasting=True)
    first = found.where("n > 0").groupBy("comp").agg(F.min(F.struct("key", "node")).alias("first"))
    judged = found.where("n > 0").join(first, "comp").select("key", "node", (F.struct("key", "node") == F.col("first")).alias("stays"))
    judged = judged.union(found.where("n = 0").select("key", "node", F.lit(True).alias("stays")))
    keys = judged.groupBy(F.col("key").alias("__key__")).agg(F.max("stays").alias("some"), F.count("*").alias("rows"))
    keys = scratch.table(keys, "keys", lasting=True)
    same_key = F.col(key) == F.col("__key__")
    repeated = keys.where("some and rows > 1").select("__key__")
    if not repeated.limit(1).count():
        return docs.join(keys.where("not some").select("__key__"), same_key, "left_anti")
    staying = judged.where("stays").select(F.col("key").alias("__key__"), F.col("node").alias("__node__")).distinct()
    staying = scratch.table(staying.join(repeated, "__key__", "left_semi"), "staying", lasting=True)
    same = _with_nodes(docs.join(repeated, same_key, "left_semi"), text, "__row_node__")
    once = same.join(staying, same_key & (F.col("__row_node__") == F.col("__node__")), "left_semi").dropDuplicates([key, "__row_node__"])
    kept = docs.join(keys.where("not some or rows > 1").select("__key__"), same_key, "left_anti")
    return kept.unionByName(once.drop("__row_node__"))
