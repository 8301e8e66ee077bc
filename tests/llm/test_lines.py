import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import ODD_SCHEMA, odd_frame, prose

from folioseek.llm.lines import line_report, remove_frequent_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    return " ".join(re.sub("[1-9]", "0", re.sub("[A-Z]", lambda m: m.group().lower(), line)).split())


def stats(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    cover = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def brute(rows, max_docs, max_share, min_left=0.5):
    texts = defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
    frequent = set()
    for host, all_texts in texts.items():
        counts = Counter(x for t in all_texts for x in {normal(x) for x in t.split("\n") if WORD.search(x)})
        frequent |= {(host, x) for x, n in counts.items() if n > max_docs and n > max_share * len(all_texts)}
    out = []
    for key, text, host in rows:
        s = stats(text)
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        gone = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if WORD.search(x) and (host, normal(x)) in frequent)
        out.append((key, *s, failed, gone, not failed and s[0] - gone >= s[0] * min_left))
    return out


def case():
    rng = random.Random(2)
    shared = [f"Line {i} of the site menu, {prose(rng, 12)}" for i in range(4)]
    rows = []
    for i in range(150):
        host = rng.choice(["big", "big", "small", None])
        parts = [prose(rng, rng.randint(1, 25)) for _ in range(rng.randint(0, 5))]
        parts += [re.sub(r"\d", str(i % 9 + 1), s).upper() if i % 2 else s for s in rng.sample(shared, rng.randint(0, 4))]
        if i % 10 == 0 and parts:
            parts += [parts[0], "", parts[0]]
        rows.append((i, "\n".join(parts), host))
    copied = (900, "\n".join(shared * 2) + "\n" + prose(rng, 10), "copies")
    return rows + [(901 + i, *copied[1:]) for i in range(40)]


def as_frame(spark, rows):
    return spark.createDataFrame([(k, t, h, 1, "z") for k, t, h in rows], ODD_SCHEMA).repartition(4)


def found(report):
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_removed_words kept".split()
    return sorted((tuple(r[n] for n in names) for r in report.collect()), key=lambda r: tuple((x is not None, x or 0) for x in r))


@pytest.mark.parametrize("limits", [(10, 0.001), (3, 0.3), (0, 0.0)])
def test_as_by_brute_force(spark, limits):
    rows = case()
    got = found(line_report(as_frame(spark, rows), max_docs=limits[0], max_share=limits[1]))
    assert got == sorted(brute(rows, *limits))
    # forty copies of one text are one text
    assert limits[0] == 0 or all(r[7] == 0 for r in got if r[0] >= 900)


def test_lines_are_removed(spark):
    rows = case()
    frame = as_frame(spark, rows)
    report = line_report(frame, max_docs=3)
    clean = remove_frequent_lines(frame, report)
    assert clean.columns == frame.columns
    verdicts = {r[0]: r for r in brute(rows, 3, 0.0)}
    after = {r["doc_id"]: len((r["text"] or "").split()) for r in clean.collect()}
    assert set(after) == {k for k, v in verdicts.items() if v[-1]}
    assert all(n == verdicts[k][1] - verdicts[k][7] for k, n in after.items())


def test_odd_rows_and_empty_table(spark):
    frame = odd_frame(spark)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]
    assert found(line_report(frame)) == sorted(brute(rows, 10, 0.0), key=lambda r: tuple((x is not None, x or 0) for x in r))
    assert line_report(odd_frame(spark, [])).count() == 0
