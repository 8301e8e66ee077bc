from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from folioseek.operators import keyed
from folioseek.operators.keyed import create_table, current, delete_from_table, read_table, upsert_table


def table(spark, path, n=200, buckets=8):
    rows = spark.range(n).select("id", (F.col("id") % 7).alias("value"), F.lit("x").alias("name"))
    return create_table(rows, path, ["id"], buckets)


def values(spark, path):
    return {r["id"]: r["value"] for r in read_table(spark, path).collect()}


def test_one_key_rewrites_one_bucket(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = table(spark, path)
    assert len(first.holds) == 8
    new = upsert_table(path, spark.createDataFrame([(5, 99, "y")], "id long, value long, name string"), ["id"])
    changed = [b for b in new.holds if new.holds[b] != first.holds[b]]
    assert len(changed) == 1 and new.number == 1
    assert values(spark, path) == {i: 99 if i == 5 else i % 7 for i in range(200)}
    files = read_table(spark, path).inputFiles()
    assert sum(new.holds[changed[0]] in f for f in files) == 1
    assert read_table(spark, path).schema == first.schema == new.schema


def test_repeated_keys_new_keys_and_deletions(spark, tmp_path):
    path = f"{tmp_path}/t"
    table(spark, path, 20, 4)
    edits = [(3, 1, "b"), (3, 2, "c"), (900, 5, None), (None, 6, None)]
    upsert_table(path, spark.createDataFrame(edits, "id long, value long, name string"), ["id"], [F.col("value")])
    now = values(spark, path)
    assert now[3] == 2 and now[900] == 5 and now[None] == 6 and len(now) == 22
    delete_from_table(path, spark.createDataFrame([(3,), (3,), (4000,)], "id int"), "id")
    assert set(values(spark, path)) == set(now) - {3}
    everything = spark.range(1000).select("id")
    delete_from_table(path, everything, "id")
    assert set(values(spark, path)) == {None}
    before = current(spark, path)
    assert delete_from_table(path, everything.limit(0), "id") == before


def test_empty_table_and_misuse(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(ValueError):
        read_table(spark, path)
    table(spark, path, 0)
    assert read_table(spark, path).count() == 0
    with pytest.raises(ValueError):
        table(spark, path)
    with pytest.raises(ValueError):
        delete_from_table(path, spark.createDataFrame([("x",)], "name string"), "name")
    upsert_table(path, spark.createDataFrame([(1, 2, "z")], "id long, value long, name string"), ["id"])
    assert values(spark, path) == {1: 2}


def test_two_writers_lose_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    table(spark, path, 40, 4)

    def save(i):
        return upsert_table(path, spark.createDataFrame([(i, 1000 + i, "w")], "id long, value long, name string"), ["id"])

    with ThreadPoolExecutor(4) as pool:
        versions = [v.number for v in pool.map(save, range(8))]
    assert sorted(versions) == list(range(1, 9))
    assert values(spark, path) == {i: 1000 + i if i < 8 else i % 7 for i in range(40)}


def test_a_writer_that_comes_second_begins_anew(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    table(spark, path, 10, 1)
    once, real = [True], keyed._commit

    def late(spark, path, version):
        if once.pop() if once else False:
            upsert_table(path, spark.createDataFrame([(1, 50, "other")], "id long, value long, name string"), ["id"])
        return real(spark, path, version)

    monkeypatch.setattr(keyed, "_commit", late)
    upsert_table(path, spark.createDataFrame([(2, 60, "mine")], "id long, value long, name string"), ["id"])
    now = values(spark, path)
    assert now[1] == 50 and now[2] == 60 and current(spark, path).number == 2
