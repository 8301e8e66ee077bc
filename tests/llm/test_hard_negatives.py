import math
import random

import duckdb
import numpy as np
import pytest

from folioseek.llm import hard_negatives
from folioseek.llm.hard_negatives import Fields
from folioseek.llm.queries import op13_hard_negatives
from folioseek.llm.sql import SQL

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank int"


def brute(rows):
    """The result from (vec_id, embedding, label) rows with labels as they are, by all pairs."""
    valid = [
        (k, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v], l)
        for k, v, l in rows
        if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    cut = lambda s: max(-(1 << 56), min(1 << 56, s))
    out = []
    for i, (key, x, label) in enumerate(valid):
        if key is None or key % 100:
            continue
        scored = [(-cut(sum(a * b for a, b in zip(x, y))), math.inf if k is None else k, l) for j, (k, y, l) in enumerate(valid) if j != i]
        scored.sort(key=lambda r: r[:2])
        named = lambda k: None if k == math.inf else k
        for p, k, _ in [r for r in scored if r[2] == label][:5]:
            near = [r for r in scored if r[2] != label and -30 * p <= -100 * r[0] <= -90 * p][:10]
            out += [(key, named(k), n, named(m), -p, -s) for n, (s, m, _) in enumerate(near, 1)]
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()), key=str)


def vectors(rng, n, size=6):
    rows = []
    for i in range(n):
        v = [rng.gauss(0.2, 0.5) for _ in range(size)]
        rows.append((i * 10 if i % 3 else i * 100, v, rng.randint(0, 3)))
    return rows


def odd_vectors(rng):
    rows = vectors(rng, 60)
    same = rows[3][1]
    rows += [(k, same, l) for k, l in [(100, 1), (100, 1), (100, 2), (700, 1), (None, 1), (None, 2), (1, 1), (2, 2)]]
    rows += [rows[0], rows[0], (200, None, 1), (200, same, None), (300, [*same[:-1], None], 1), (300, [*same[:-1], math.nan], 1)]
    return rows + [(300, [*same[:-1], -math.inf], 1), (400, [], 1), (500, same[:3], 1), (600, [*same, 1.0], 2), (700, [0.0] * 6, 0), (-100, same, -1)]


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e200])
def test_against_all_pairs(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "GROUP", 16)
    monkeypatch.setattr(hard_negatives, "TILE", 4)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 1000)
    rows = [(k, v and [x and x * scale for x in v], l) for k, v, l in odd_vectors(random.Random(8))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    want = brute(rows)
    assert len(want) >= 100  # saturated scores are all equal
    assert result(hard_negatives.mine(df)) == want


def test_query_against_sql(spark, tmp_path):
    rows = [r for r in odd_vectors(random.Random(9)) if r[0] is None or r[0] >= 0]
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = result(op13_hard_negatives(spark, str(tmp_path)))
    columns = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    assert got == sorted(con.execute(f"SELECT {columns} FROM ({SQL['op13_hard_negatives']})").fetchall(), key=str)
    moved = [(k, v, (l + 1) % 10 if l is not None and k is not None and k % 7 == 0 else l) for k, v, l in rows]
    assert got == brute(moved)


def test_empty_and_without_anchors(spark):
    df = spark.createDataFrame([(1, [1.0], 1, "x", 1), (2, [1.0], 2, "x", 1)], SCHEMA)
    assert hard_negatives.mine(df).count() == 0
    assert hard_negatives.mine(df.limit(0)).count() == 0


@pytest.mark.parametrize("top, size, wide", [(3, 2, False), (255, 64, False), (1 << 40, 5, True)])
def test_products_in_fields_are_exact(top, size, wide):
    rng = random.Random(top)
    rows = [[rng.randint(-top, top) for _ in range(size)] for _ in range(37)]
    fields = Fields.fitting(-top, top, size)
    assert fields.wide == wide and fields.count >= 2
    x = fields.biased([np.array(r, object if wide else np.int64) for r in rows])
    packed = fields.pack(x)
    assert (fields.loaded(fields.dumped(packed), np.uint64).reshape(packed.shape) == packed).all()
    want = [[max(-(1 << 56), min(1 << 56, sum(a * b for a, b in zip(r, s)))) for s in rows] for r in rows]
    assert fields.scores(x, packed, x.sum(axis=1)).tolist() == want
