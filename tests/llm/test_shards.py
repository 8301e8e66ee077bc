import random
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import ODD_SCHEMA, odd_frame, prose

from folioseek.llm.shards import balanced_shards, quotas


def checked(spark, rows, n):
    frame = spark.createDataFrame([(k, t, "s", 1, "z") for k, t in rows], ODD_SCHEMA).repartition(3)
    got = balanced_shards(frame, n_shards=n).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
        (k is not None, k or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows
    )
    counts = Counter(r["shard"] for r in got)
    sizes = [counts.get(s, 0) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(n))
    for s in counts:
        mine = sorted((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0) for r in got if r["shard"] == s)
        assert [x[0] for x in mine] == list(range(len(mine))) and [x[1:] for x in mine] == sorted(x[1:] for x in mine)
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    texts = defaultdict(Counter)
    by_key = dict(rows)
    for r in got:
        texts[by_key[r["doc_id"]] or ""][r["shard"]] += 1
    return texts


def groups(sizes, singles, seed=1):
    rng = random.Random(seed)
    texts = [t for i, s in enumerate(sizes) for t in [f"group {i} " + prose(rng, 5)] * s] + [f"single {i}" for i in range(singles)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_groups_stay_together(spark):
    texts = checked(spark, groups([2] * 40 + [5] * 20 + [12, 17], 300), 10)
    cut = sum(len(c) > 1 for c in texts.values())
    assert cut <= 2


def test_a_group_of_a_third_of_all_rows(spark):
    texts = checked(spark, groups([200] + [3] * 30, 310), 10)
    hot = max(texts.values(), key=lambda c: sum(c.values()))
    assert len(hot) <= 5  # four shards at least
    assert sum(len(c) > 1 for c in texts.values()) <= 5


@pytest.mark.parametrize("sizes, singles, n", [([30], 0, 7), ([2] * 10, 0, 6), ([], 5, 40), ([], 0, 3), ([3], 1, 40), ([9, 9], 2, 3)])
def test_sizes_are_exact(spark, sizes, singles, n):
    checked(spark, groups(sizes, singles), n)


def test_odd_rows_and_empty_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_frame(spark).collect()]
    frame = odd_frame(spark)
    got = balanced_shards(frame, n_shards=4).collect()
    assert len(got) == len(rows) and sorted(Counter(r["shard"] for r in got).values()) == [2, 3, 3, 3]
    assert balanced_shards(odd_frame(spark, [])).count() == 0


def test_quotas_never_overfill():
    rng = random.Random(2)
    for _ in range(200):
        wanted = [(s, g, r, rng.randint(1, 9)) for s in range(4) for g in range(4) for r in range(2) if s != g and rng.random() < 0.7]
        room = [rng.randint(0, 10) for _ in range(4)]
        load = [0] * 4
        for s, g, _, take, asked in quotas(wanted, room):
            assert 0 <= take <= asked
            load[g] += take
            load[s] -= take
        assert all(x <= r for x, r in zip(load, room))
