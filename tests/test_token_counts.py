"""Tokens by key: rows are counted where they are made; keys of several rows count their kinds together."""
from __future__ import annotations

import re
from collections import defaultdict

import pytest

from checks.queries import QUERIES
from folioseek.functions.text import index_tokens
from folioseek.operators import index as ix

ROWS = [
    ("a", 0, "one two two CY-1578 黏度计 z"),
    ("a", 1, "one"),
    ("b", 0, "x y x"),
    ("b", 0, "y 黏度 w"),
    ("b", 0, "y x x"),
    ("b", None, "null seq"),
    ("b", None, "seq null q"),
    (None, 0, "p q"),
    (None, 0, "q p"),
    (None, 0, "r q"),
    (None, None, "alone"),
    ("c", 0, "copy of it"),
    ("c", 0, "copy of it"),
    ("d", 0, "half"),
    ("d", 0, " --- "),
    ("d", 0, None),
    ("e", 0, None),
    ("f", 0, "。"),
    ("f", 0, ""),
]


def counted(rows):
    """The figures by brute force, from rows (doc_id, seq, content)."""
    held = defaultdict(list)
    for r in rows.select("doc_id", "seq", index_tokens(ix.F.col("content")).alias("tokens")).collect():
        held[r.doc_id, r.seq] += r.tokens
    return {k: (len(t), len(set(t)), sum(map(len, t)), max(t, key=lambda w: w.encode())) for k, t in held.items() if t}


def view(df):
    assert df.columns == ["doc_id", "seq", "n", "kinds", "chars", "last"]
    rows = df.collect()
    assert len({(r.doc_id, r.seq) for r in rows}) == len(rows)
    return {(r.doc_id, r.seq): tuple(r)[2:] for r in rows}


@pytest.mark.parametrize("held", [0, 5, 100_000])
def test_keys_of_several_rows(spark, monkeypatch, held):
    monkeypatch.setattr(ix, "HELD_TOKENS", held)
    rows = spark.createDataFrame(ROWS, "doc_id string, seq int, content string").repartition(3)
    got = view(ix.token_counts(rows))
    assert got == counted(rows)
    assert got["b", 0] == (11, 6, 12, "黏度") and got[None, 0] == (6, 3, 6, "r") and got["d", 0] == (1, 1, 4, "half") and len(got) == 8


def test_keys_of_one_row(spark):
    rows = spark.createDataFrame([r for r in ROWS if r[0] in ("a", "e")], "doc_id string, seq int, content string")
    assert view(ix.token_counts(rows)) == counted(rows)
    assert view(ix.token_counts(rows.filter("false"))) == {}


def test_tokens_do_not_cross_the_network(spark, tmp_path, monkeypatch, capsys):
    """Token by token, with the keys beside each, a shuffle was several times the input."""
    texts = [(i, f"one two two w{i % 3} z.\n黏度 next {i}", "en", "src", 9) for i in range(20)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    written = ix.written
    monkeypatch.setattr(ix, "written", lambda df, *label: (df.explain("formatted"), written(df, *label))[1])
    found = QUERIES["R1_tokens"](spark, str(tmp_path))
    found.explain("formatted")
    nodes = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: (.*)", capsys.readouterr().out)
    assert nodes and not [n for n in nodes if "token" in "".join(n)]
    assert found.count() == 46
