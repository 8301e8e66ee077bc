"""Operator 10: sharding by balanced label propagation over groups of equal texts.

Law `rows`: the sizes of any two shards, in rows, are at most one apart. A group's links are a star around its
text's hash, and members of a group on one shard are alike, so the state is one row per (group, shard) with a
number of members, however large the group. Rounds of joins move members from a group's smaller parts to its
largest part, within quotas per pair of shards: what flows the other way, and a part of the room that
is left. A part that fills a shard stays, and the next one becomes the goal. Rounds end when nothing moves.
Documents without links then fill the shards to their exact sizes; a group cut by a quota keeps most members together.

Null texts count as empty (crc32 0, size 16), and they are one group with the empty texts. Repeated rows and keys are rows
of their own; null keys come first in the order of slots. An empty table gives an empty result. With fewer rows than
shards, the first shards get one row each.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import Scratch, arrow_schema

#: Movers of one pair of shards are accepted by parts of this many hash ranges.
RANGES = 16
#: A shard with less than one part in FULL of its room left is nearly full.
FULL = 20
TASK_ROWS = 200_000


def numbered(scratch: Scratch, rows: DataFrame, order: list[str], n_rows: int, to: str = "rank") -> DataFrame:
    """`rows` with gapless numbers from 0 in the given order: ranges, numbers within each, and sums over the ranges."""
    n = max(1, math.ceil(n_rows / TASK_ROWS))
    if n_rows:
        n = max(n, min(rows.sparkSession.sparkContext.defaultParallelism, n_rows))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "part int, at long"])
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            k = batch.num_rows
            new = [pa.array([part] * k, pa.int32()), pa.array(range(at, at + k), pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, *new], schema)], schema=schema)
            at += k

    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    table = scratch.table(dealt.mapInArrow(task, ddl), "numbered")
    total, starts = 0, []
    for r in table.groupBy("part").count().orderBy("part").collect():  # one row per range
        starts.append((r["part"], total))
        total += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "part int, start long")
    return table.join(F.broadcast(starts), "part").withColumn(to, F.col("start") + F.col("at")).drop("part", "at", "start")


def propagated(scratch: Scratch, parts: DataFrame, capacity: list[int], rounds: int) -> DataFrame:
    """parts (hub, shard, n) after balanced label propagation; `capacity` in rows, by shard."""
    spark, n = parts.sparkSession, len(capacity)
    parts = scratch.table(parts, "parts")
    for turn in range(rounds):
        # at most n x n x RANGES rows from here to the quotas
        loads = {r["shard"]: r["n"] for r in parts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [max(0, c - loads.get(s, 0)) for s, c in enumerate(capacity)]
        state = spark.createDataFrame([(s, capacity[s], room[s]) for s in range(n)], "shard int, capacity long, room long")
        ranked = parts.join(F.broadcast(state), "shard")
        # a part with most of a nearly full shard stays where it is and is no goal
        settled = (F.col("room") * FULL <= F.col("capacity")) & (F.col("n") * 2 > F.col("capacity"))
        live = ranked.where(~settled).select("hub", "shard", "n")
        weight = F.struct("n", F.xxhash64("hub", "shard").alias("chance"), "shard")
        goals = live.groupBy("hub").agg(F.max(weight).alias("goal")).select("hub", F.col("goal.shard").alias("goal"))
        moves = live.join(goals, "hub").where("shard <> goal")
        moves = scratch.table(moves.withColumn("range", F.pmod(F.xxhash64("hub", F.lit(turn)), F.lit(RANGES)).cast("int")), "moves")
        wanted = moves.groupBy("shard", "goal", "range").agg(F.sum("n").alias("n")).collect()
        if not wanted:
            break
        grants = quotas(sorted(((r["shard"], r["goal"], r["range"], r["n"]) for r in wanted)), room)
        if not any(g[3] for g in grants):
            break
        granted = spark.createDataFrame(grants, "shard int, goal int, range int, allowed long, asked long")
        taken = moves.join(F.broadcast(granted), ["shard", "goal", "range"])
        taken = taken.withColumn("moved", F.floor(F.col("n") * (F.col("allowed") / F.col("asked"))).cast("long"))
        taken = taken.withColumn("moved", F.least("moved", "n")).where("moved > 0")
        out = taken.select("hub", "shard", (-F.col("moved")).alias("n")).union(taken.select("hub", F.col("goal").alias("shard"), F.col("moved").alias("n")))
        parts = scratch.table(parts.union(out).groupBy("hub", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "parts")
    return parts


def quotas(wanted: list[tuple[int, int, int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(shard, goal, range, allowed, asked): a pair may swap what flows both ways, and fill a goal's room in proportion."""
    flow: dict[tuple[int, int], int] = {}
    for s, g, _, n in wanted:
        flow[s, g] = flow.get((s, g), 0) + n
    beyond = {p: f - min(f, flow.get(p[::-1], 0)) for p, f in flow.items()}
    into: dict[int, int] = {}
    for (_, g), b in beyond.items():
        into[g] = into.get(g, 0) + b
    share = {p: min(b, room[p[1]] * b // into[p[1]]) if b else 0 for p, b in beyond.items()}
    spare = dict(enumerate(room))
    for p, given in share.items():
        spare[p[1]] -= given
    for p, b in beyond.items():  # what rounding left
        more = min(b - share[p], max(0, spare[p[1]]))
        share[p] += more
        spare[p[1]] -= more
    left = {p: f - beyond[p] + share[p] for p, f in flow.items()}
    out = []
    for s, g, r, n in wanted:
        take = min(n, left[s, g])
        left[s, g] -= take
        out.append((s, g, r, take, n))
    return out


def by_ranges(value: Column, ends: list[int]) -> Column:
    """Index of the range that holds `value`: the number of ends that are not above it."""
    found = F.filter(F.array(*map(F.lit, ends)), lambda e: e <= value)
    return F.size(found).cast("int")


def balanced_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 40, rounds: int = 24) -> DataFrame:
    """Per row of `docs`: `key`, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    scratch = Scratch(docs.sparkSession, "shards")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        F.xxhash64(body, F.length(body)).alias("hub"),
    )
    rows = scratch.table(rows, "rows")
    total = rows.count()
    capacity = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    groups = rows.groupBy("hub").agg(F.count("*").alias("members")).where("members > 1").select("hub")
    linked = scratch.table(rows.join(groups, "hub"), "linked")
    n_linked = linked.count()
    linked = scratch.table(numbered(scratch, linked, ["hub", "row"], n_linked), "linked")
    start = linked.groupBy("hub", (F.col("rank") % n_shards).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    parts = propagated(scratch, start, capacity, rounds)
    firsts = linked.groupBy("hub").agg(F.min("rank").alias("first"))
    ranges = parts.groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("parts")).join(firsts, "hub")
    placed = linked.join(ranges, "hub")
    # the member with number r in its group is in the part that reaches over r
    zero = F.struct((F.col("rank") - F.col("first")).alias("left"), F.lit(-1).alias("shard"))
    walk = F.aggregate("parts", zero, lambda a, p: F.struct((a["left"] - p["n"]).alias("left"),
                       F.when((a["left"] >= 0) & (a["left"] < p["n"]), p["shard"]).otherwise(a["shard"]).alias("shard")))
    placed = scratch.table(placed.select("row", "key", "size", "crc", "hub", walk["shard"].cast("int").alias("shard")), "placed")
    placed, spilled, counts = within(scratch, placed, capacity, n_linked)
    free = rows.join(groups, "hub", "left_anti").select("row", "key", "size", "crc").union(spilled)
    ends, at = [], 0
    for c, have in zip(capacity, counts):
        at += c - have
        ends.append(at)
    free = numbered(scratch, free, ["row"], at)
    filled = free.select("row", "key", "size", "crc", by_ranges(F.col("rank"), ends).alias("shard"))
    every = scratch.table(placed.union(filled), "every")
    ordered = numbered(scratch, every, ["shard", "key", "row"], total)
    starts = [sum(capacity[:s]) for s in range(n_shards)]
    slot = F.col("rank") - F.element_at(F.array(*map(F.lit, starts)), F.col("shard") + 1)
    out = ordered.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
    out = scratch.table(out, "out", lasting=True)
    scratch.drop()
    return out


def within(scratch: Scratch, placed: DataFrame, capacity: list[int], n: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Placed rows within the capacities, rows beyond them (the last groups of a shard), and the rows kept by shard."""
    have = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}  # one row per shard
    counts = [min(c, have.get(s, 0)) for s, c in enumerate(capacity)]
    columns = ["row", "key", "size", "crc"]
    if all(have.get(s, 0) <= c for s, c in enumerate(capacity)):
        return placed.select(*columns, "shard"), placed.select(*columns).limit(0), counts
    starts, at = [], 0
    for s in range(len(capacity)):
        starts.append(at)
        at += have.get(s, 0)
    ranked = scratch.table(numbered(scratch, placed, ["shard", "hub", "row"], n), "ranked")
    shard = F.col("shard") + 1
    inside = F.col("rank") - F.element_at(F.array(*map(F.lit, starts)), shard) < F.element_at(F.array(*map(F.lit, capacity)), shard)
    return ranked.where(inside).select(*columns, "shard"), ranked.where(~inside).select(*columns), counts
