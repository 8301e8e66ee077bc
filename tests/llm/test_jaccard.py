import random
from collections import Counter

import numpy as np
import pytest
from helpers import ODD_SCHEMA, odd_frame, prose

from folioseek.llm import jaccard
from folioseek.llm.jaccard import first_of_each_component, packed, similar_components, unpacked


def brute(rows):
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = {}
    for i, s in enumerate(sets):
        shared = Counter(j for k in s for j in lists.get(k, ()))
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for k in s:
            lists.setdefault(k, []).append(i)
    groups = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            groups[root(i)] = min(key, groups.get(root(i), key))
    return [(key, len(sets[i]), groups.get(root(i))) for i, (key, _) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def edited(rng, text, share):
    return " ".join(f"{w}{rng.randint(0, 99)}" if rng.random() < share else w for w in text.split())


def corpus(seed, near=60, chain=25):
    rng = random.Random(seed)
    rows = [prose(rng, rng.randint(1, 90)) for _ in range(80)]
    base = prose(rng, 120)
    rows += [edited(rng, base, 0.02) for _ in range(near)]  # many near copies, some of them below the limit
    rows += [base] * 15
    link = prose(rng, 100)
    for _ in range(chain):  # each like the one before
        link = edited(rng, link, 0.015)
        rows.append(link)
    passage = prose(rng, 60)
    rows += [f"{passage} {prose(rng, rng.randint(1, 40))}" for _ in range(40)]  # a passage in unlike documents
    rows += ["a b", "A  B", "a", None, "", "  ", "one two three four five", "one two three four five five"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_as_by_brute_force(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame([(k, t, "s", 1, "z") for k, t in rows], ODD_SCHEMA).repartition(5)
    assert order(tuple(r) for r in similar_components(frame).collect()) == order(brute(rows))


def test_fewer_turns_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON_DOCS", 3)
    monkeypatch.setattr(jaccard, "LEADER_PAIRS", 4)
    rows = corpus(3, near=25, chain=12)
    frame = spark.createDataFrame([(k, t, "s", 1, "z") for k, t in rows], ODD_SCHEMA)
    want = order(brute(rows))
    assert order(tuple(r) for r in similar_components(frame, turns=0).collect()) == want
    assert order(tuple(r) for r in similar_components(frame, turns=1).collect()) == want


def test_packed_counts():
    rng = random.Random(1)
    for n in (0, 1, 500):
        x = np.sort(np.array([rng.choice([rng.randrange(1 << 26), 65535, 65534, 131070]) for _ in range(n)], np.uint32))
        assert unpacked(packed(x, 0), 0).tolist() == x.tolist()


def test_odd_rows_and_empty_table(spark):
    frame = odd_frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert order(tuple(r) for r in similar_components(frame).collect()) == order(brute(rows))
    assert similar_components(odd_frame(spark, [])).count() == 0
    kept = first_of_each_component(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [
        (False, 0), (True, 1), (True, 2), (True, 3), (True, 4), (True, 6), (True, 8), (True, 9)
    ]


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    rng = random.Random(5)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    texts = [(1, a), (2, a + " end"), (2, b), (2, c), (2, c), (3, b), (4, d), (4, e), (4, ""), (4, None), (5, None), (None, a)]
    frame = spark.createDataFrame([(k, t, "s", 1, "z") for k, t in texts], ODD_SCHEMA).repartition(4)
    got = [(r["doc_id"], r["text"] or "") for r in first_of_each_component(frame).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (2, c), (4, d), (4, e), (4, ""), (5, ""), (None, a)], key=str)
    swapped = spark.createDataFrame([(k, t, "s", 1, "z") for k, t in [(1, a), (1, b), (0, b)]], ODD_SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in first_of_each_component(swapped).collect()) == [(0, b), (1, a)]
