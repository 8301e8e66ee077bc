import random

import pytest
from helpers import ODD_SCHEMA, odd_frame, prose

from folioseek.llm.decontaminate import drop_contaminated, is_contaminated, n_hit, remove_spans, scan_benchmark, words_of


def brute(text, items, n=13):
    """(words, hit words, items), window by window."""
    words, hit, found = words_of((text or "").encode()), set(), set()
    for item, passage in items:
        p = words_of((passage or "").encode())
        k = min(n, len(p))
        windows = {tuple(p[i : i + k]) for i in range(len(p) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add("null" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def case():
    rng = random.Random(1)
    items = [(i, prose(rng, rng.randint(14, 40))) for i in range(30)]
    items += [(30, "Short one here"), (31, None), (32, "..."), (33, items[3][1]), (33, items[4][1]), (None, items[5][1])]
    docs = []
    for i in range(120):
        text = prose(rng, rng.randint(0, 80))
        if i % 3 == 0:
            words = rng.choice(items[:30])[1].split()
            a = rng.randint(0, len(words) - 5)
            text = f"{text} {' '.join(words[a:])}; {prose(rng, rng.randint(0, 300))}"
        if i % 7 == 0:
            text += " SHORT, one-here! "
        docs.append((i, text, "s", 1, "z"))
    return docs + [(500, None, None, 1, "z"), (501, "", None, 1, "z"), (502, "é" * 30, None, 1, "z")], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_hits_as_by_brute_force(spark, block_bytes):
    docs, items = case()
    frame = spark.createDataFrame(docs, ODD_SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    scanned = scan_benchmark(frame, benchmark, block_bytes=block_bytes)
    rows = scanned.select("doc_id", "text", "n_words", n_hit().alias("n_hit"), "items", is_contaminated().alias("bad"))
    count = 0
    for r in rows.collect():
        want = brute(r["text"], items)
        assert (r["n_words"], r["n_hit"], r["items"]) == want
        assert r["bad"] == (want[1] > 0 and 20 * want[1] >= want[0])
        count += bool(want[1])
    assert count > 30
    kept = drop_contaminated(frame, benchmark, block_bytes=block_bytes)
    assert kept.columns == frame.columns
    assert {tuple(r) for r in kept.collect()} == {d for d in docs if not (lambda w: w[1] > 0 and 20 * w[1] >= w[0])(brute(d[1], items))}
    for r in remove_spans(scanned).collect():
        n, hit, _ = brute(docs[[d[0] for d in docs].index(r["doc_id"])][1], items)
        assert len(words_of((r["text"] or "").encode())) == n - hit


def test_odd_rows_and_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert drop_contaminated(odd_frame(spark), empty).count() == 11
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert scan_benchmark(odd_frame(spark, []), items).count() == 0
    gone = {r["doc_id"] for r in odd_frame(spark).collect()} - {r["doc_id"] for r in drop_contaminated(odd_frame(spark), items).collect()}
    assert gone == {8}
