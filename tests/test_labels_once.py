"""Labels of stored chunks serve both ways of reclassifying."""
from __future__ import annotations

from folioseek.operators import library


def test_labels_made_once_give_the_same_results(spark):
    docs = spark.createDataFrame([("a", "x.txt", None, None), ("b", "y.txt", "OLD", "other")], "doc_id string, name string, model string, kind string")
    chunks = spark.createDataFrame([("a", 0, "CY-1578 CY-1578 TDS"), ("b", 0, "HY-951 and HY-951"), ("b", 1, "MSDS")], "doc_id string, seq int, content string")
    labels = library.chunk_labels(chunks)
    for fill_only in (False, True):
        want = sorted(tuple(r) for r in library.reclassified(docs, chunks, fill_only).collect())
        assert sorted(tuple(r) for r in library.reclassified(docs, None, fill_only, labels=labels).collect()) == want
