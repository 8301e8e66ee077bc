"""Spans are dealt once; bands that lie in several slabs come out as if the page were one slab."""
from __future__ import annotations

import random
import re

from folioseek.operators import spans as sp

SPAN = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, size double, text string"


def page(spark, seed=3, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y0, size = 9.0 * (i // 5) + rng.random() * 4 - 200, rng.choice([8.0, 9.0, 30.0])
        rows.append(("d", 1 + i % 2, float(i % 5), y0, float(i % 5) + 0.5, y0 + size * rng.choice([1.0, 0.2]), size, f"w{i}"))
    return spark.createDataFrame([*rows, ("d", 1, 0.0, None, 1.0, 5.0, 8.0, "nowhere"), (None, 1, 0.0, 1.0, 1.0, 5.0, 8.0, "lost")], SPAN)


def test_bands_over_slabs(spark, monkeypatch):
    df = page(spark)
    view = lambda: [tuple(r) for r in sp.span_rows(df).select("page", "band", "row", "y0", "x0", "text").orderBy("page", "band", "row", "y0", "x0").collect()]
    monkeypatch.setattr(sp, "SLAB", 1e9)
    whole = view()
    assert len(whole) == 600
    monkeypatch.setattr(sp, "SLAB", 0.7)
    assert not sp._bands(page(spark).withColumn("mid", (sp.F.col("y0") + sp.F.col("y1")) / 2)).filter("not alone").isEmpty()
    assert view() == whole


def test_texts_of_spans_cross_the_network_once(spark, capsys):
    lines = [("d", 1, 60.0 * (i % 4), 14.0 * (i // 4), 60.0 * (i % 4) + 30, 14.0 * (i // 4) + 12, 12.0, "w") for i in range(400)]
    sp.span_rows(spark.createDataFrame(lines, SPAN)).explain("formatted")
    nodes = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    assert sum("text#" in n or "members#" in n or "buf#" in n for n in nodes) == 1
