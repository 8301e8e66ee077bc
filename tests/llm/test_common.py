import pyarrow as pa

from folioseek.llm import common
from folioseek.llm.common import Memo, Scratch, crc_mod, text_slices


def test_slices_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    texts = ["abc", None, "x" * 25, "", "de", "é" * 4, "f"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["n", "text"])
    parts = list(text_slices([batch.slice(0, 0), batch], "text"))
    assert [t for _, ts in parts for t in ts] == [None if t is None else t.encode() for t in texts]
    assert [n for b, _ in parts for n in b.column(0).to_pylist()] == list(range(7))
    assert all(sum(len(t or b"") for t in ts) <= 10 or len(ts) == 1 for _, ts in parts)


def test_memo_stays_within_its_limit():
    memo = Memo(8)
    for i in range(100):
        memo.room(1)
        memo[i] = i
        assert len(memo) <= 8
    assert 0 in memo


def test_scratch_is_dropped_and_lasting_stays(spark):
    scratch = Scratch(spark, "test")
    kept = scratch.table(spark.range(3), "kept", lasting=True)
    gone = scratch.table(spark.range(3), "gone")
    assert gone.count() == 3
    scratch.drop()
    assert kept.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch.short)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_crc_of_keys(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "k long")
    for r in rows.select("k", crc_mod(rows.k, 4).alias("m")).collect():
        assert r.m == (0 if r.k is None else zlib.crc32(str(r.k).encode()) % 4)
