import hashlib
import random

import public_tokenizers
import pytest
from helpers import in_order, odd_frame, odd_rows
from tokenizers import Tokenizer

from folioseek.llm.bpe import LONG_PIECE, RankedVocabulary, bpe_decode, bpe_encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return RankedVocabulary(PATH)


def texts():
    rng = random.Random(3)
    ranges = [(32, 127), (0xA0, 0x250), (0x300, 0x330), (0x370, 0x400), (0x4E00, 0x4E20), (0xAC00, 0xAC20), (0x1F600, 0x1F610)]
    letters = [chr(c) for a, b in ranges for c in range(a, b)] + list("\x1c\x85 ‍﻿\n\r\t\x00")
    yield from ["", "Hello  World!! it's 123 don't élan", "a<|endoftext|>b <|ENDOFTEXT|>", "T̈ ẗ", "İSTANBUL ΑΣ", "ab" * LONG_PIECE + "é" * 900]
    for _ in range(1500):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(1, 50)))


def test_ids_and_decoding_as_the_library(library, own):
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_pieces_merge_as_short_ones(own):
    rng = random.Random(4)
    for _ in range(50):
        parts = [own.inner[rng.choice(b"aeinrst")] for _ in range(60)]
        parts.append(own.last[ord("n")])
        short = own.merge(bytes(next(b for b in range(97, 123) if own.inner[b] == p) for p in parts[:-1]) + b"n")
        assert own._merge_long(list(parts)) == short


def test_frame_of_odd_rows(spark, library):
    rows = bpe_encode(odd_frame(spark), PATH, results=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert [r["doc_id"] for r in rows] == [r[0] for r in odd_rows()]
    for r, given in zip(rows, odd_rows()):
        ids = library.encode(given[1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), decoded)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert (r["text"], r["items"], r["n_words"]) == (given[1], given[4], given[3])


def test_small_memo_and_empty_table(spark):
    docs = odd_frame(spark)
    assert in_order(bpe_encode(docs, PATH, memo_runs=4).collect()) == in_order(bpe_encode(docs, PATH).collect())
    assert bpe_encode(odd_frame(spark, []), PATH).count() == 0


def test_decode_column(spark):
    encoded = bpe_encode(odd_frame(spark), PATH).withColumnRenamed("decoded", "want")
    assert all(r["decoded"] == r["want"] for r in bpe_decode(encoded, PATH).collect())
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe_decode(nulls, PATH).collect()] == [None, ""]
