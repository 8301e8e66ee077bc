"""The work of a search: hits are not sorted again for each block, scopes are looked up once, hits are cut into tokens once."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from folioseek.operators import blocks, keyword
from folioseek.operators.blocks import ScopeMask
from folioseek.operators.index import BLOCK, scratch_index
from folioseek.operators.keyword import keyword_search


def test_hits_that_may_all_win_are_sorted_seldom(monkeypatch):
    monkeypatch.setattr(keyword, "HELD_HITS", 100)
    sorted_hits = []
    cut = keyword._Hits.cut
    monkeypatch.setattr(keyword._Hits, "cut", lambda self: (sorted_hits.append(self.n), cut(self)))
    hits = keyword._Hits(np.array([2.5]), 3)
    for block in range(400):
        hits.add(np.full((1, 4), 1.0), block * BLOCK)
    assert hits.n == 1600 and sum(sorted_hits) < 20 * hits.n


def test_a_scope_is_looked_up_once():
    asked = pa.table({"only_pinned": [False] * 6, "scope_category": ["a", "b"] * 3, "scope_tags": [["x", "y"], ["y", "x"]] * 3})
    rows = pa.RecordBatch.from_pydict({"pinned": [True, None], "category": ["a", "b"], "tags": [["y"], ["x"]]})
    mask, scores = ScopeMask(asked), np.ones((6, 2))
    mask.apply(scores, rows, np.array([False, False]))
    assert len(mask.rules) == 2 and scores.tolist() == [[1, 0], [0, 1]] * 3


def library(spark):
    words = [f"w{i}" for i in range(9)]
    made = [(f"d{i:03}", i % 3, " ".join([*words[i % 5 :], *words[: i % 4], "same"])) for i in range(700)]
    return scratch_index(spark.createDataFrame(made, "doc_id string, seq int, content string").selectExpr("*", "1 AS page_no"), "work")


def asked(spark):
    return spark.createDataFrame([(i, f"w{i} same w{8 - i} w3 none w1") for i in range(7)], "query_id int, text string")


def test_terms_laid_out_in_parts_give_the_same_scores(spark, monkeypatch):
    index = library(spark)
    view = lambda: [tuple(r) for r in keyword_search(index, asked(spark), 9).orderBy("query_id", "rank").collect()]
    whole = view()
    monkeypatch.setattr(blocks, "CELLS", 3 * BLOCK)
    assert view() == whole and len(whole) == 63
    raw = {}
    for r in whole:  # equal texts score alike to the last bit, whatever block they are in
        raw.setdefault((r[0], r[5]), set()).add(r[6])
    assert all(len(scores) == 1 for scores in raw.values())


def test_tokens_of_a_hit_are_cut_once(spark):
    hits = keyword_search(library(spark), asked(spark), 4)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and "lambdafunction(array_contains" not in plan
    assert {r.query_id: r.matched for r in hits.where("rank = 1").collect()}[0] == ["w1", "w0", "w3", "same", "w8"]
