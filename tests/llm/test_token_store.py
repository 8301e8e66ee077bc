import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from helpers import odd_frame, odd_rows
from tokenizers import Tokenizer

from folioseek.llm.token_store import IndexFile, _LibraryPieces, PerfectHash, find_keys, index_bytes, key_column, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 20_000])
def test_perfect_and_minimal(n):
    keys = np.array(random.Random(n).sample(range(-(10**12), 10**12), n), np.int64)
    assert sorted(PerfectHash.build(keys).slots(keys).tolist()) == list(range(n))


def test_repeated_keys_are_refused():
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5]))


def test_index_file_knows_its_keys_and_no_others():
    keys = np.arange(0, 60_000, 3)
    index = IndexFile(index_bytes(keys, keys % 7, keys * 2, np.ones_like(keys)))
    found = index.find(keys)
    assert (found["first"] == keys * 2).all() and (found["shard"] == keys % 7).all()
    assert index.find(np.arange(1, 60_000, 3))["count"].sum() == 0
    assert IndexFile(index_bytes(*[np.zeros(0, np.int64)] * 4)).find(np.array([4]))["count"].tolist() == [0]


def test_texts_of_a_slice_are_encoded_as_by_the_library():
    letters = "abSTrevlLmd'' \t19.-<>éÀŸſß²汉İ\u0301\x85"
    rnd = random.Random(5)
    plain = ["".join(rnd.choices(letters[:20], k=rnd.randint(0, 12))) for _ in range(3000)]
    odd = ["".join(rnd.choices(letters, k=rnd.randint(0, 12))) for _ in range(1000)]
    library, pieces = Tokenizer.from_file(PATH), _LibraryPieces(PATH, "<u2", 50)
    for texts in (plain, rnd.sample(plain + odd, 4000), [], [""]):
        ids, bounds = pieces.encode(pa.array([None, *[t.encode() for t in texts]], pa.binary()).slice(1))
        found = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]


def expected(rows):
    library, at, out = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 900, "bucket_keys": 3, "memo_pieces": 16}])
def test_round_trip_of_odd_rows(spark, tmp_path, options):
    docs = odd_frame(spark)
    store = write_tokens(docs, f"file://{tmp_path}", PATH, **options)
    found = find_keys(store, docs.select(key_column("doc_id").alias("key")).distinct())
    rows = sorted((tuple(r) for r in read_tokens(store, found).collect()), key=lambda r: r[1])
    assert rows == expected([r[:2] for r in odd_rows()])


def test_unknown_keys_and_empty_table(spark, tmp_path):
    store = write_tokens(odd_frame(spark), f"{tmp_path}/a", PATH)
    keys = spark.createDataFrame([(4,), (400,), (-4,)], "key long")
    assert {r["key"]: r["count"] for r in find_keys(store, keys).collect()} == {4: 1, 400: 0, -4: 0}
    empty = write_tokens(odd_frame(spark, []), f"{tmp_path}/b", PATH)
    assert read_tokens(empty, find_keys(empty, keys)).count() == 0
