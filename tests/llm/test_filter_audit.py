import random
from fractions import Fraction
from itertools import permutations
from math import factorial

import duckdb
from helpers import ODD_SCHEMA, odd_frame, odd_rows, prose

from folioseek.llm import filter_audit
from folioseek.llm.queries import op12_filter_audit
from folioseek.llm.sql import SQL


def brute(rows, labels):
    """Rows of the audit from (doc_id, text, lang) rows, by running every order over the documents."""
    flags = []
    for key, text, lang in rows:
        text, words = text or "", (text or "").encode().split()
        same = [k for k, t, _ in rows if (t or "") == text and k is not None]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": key is not None and key > min(same),
        }
        mine = [x for k, *x in labels if k is not None and k == key]
        flags.append((lang or "", {f for f in fails if fails[f]}, any(q == 1 for q, _ in mine), any(t == 1 for _, t in mine)))
    out = []
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        mine = []
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                early = set(order[: step - 1])
                here = [x for x in own if f in x[1] and not early & x[1]]
                kept = sum(not (early | {f}) & x[1] for x in own)
                redundant = sum(f in x[1] and bool(early & x[1]) for x in own)
                unique = sum(x[1] == {f} for x in own)
                total[f] += len(here)
                mine.append((part, order, step, kept, len(here), redundant, unique, sum(x[2] for x in here), sum(x[3] for x in here)))
        out += [(*r, total[r[1][r[2] - 1]]) for r in mine]
    return sorted(out)


def result(df):
    assert df.columns == [c.split()[0] for c in filter_audit.ORDERS.split(", ")]
    return sorted(map(tuple, df.collect()))


def odd_tables(rng):
    loud, dull, marked = "LOUD WORDS " * 60, "again and again " * 50, prose(rng, 150) + " $"
    fresh = " ".join(f"w{i}" for i in range(130))
    texts = [None, "", fresh, fresh, fresh, loud, dull, marked, marked, "A#", "é" * 20 + "AB", "\x1c\x85 a", fresh + " É", prose(rng, 3000)]
    rows = [(i, t, ["en", None, "", "fr"][i % 4]) for i, t in enumerate(texts * 3)]
    rows += [rows[2], rows[2], (2, fresh, "fr"), (None, fresh, "en"), (None, None, None), (-5, loud, "en")]
    rng.shuffle(rows)
    labels = [(i, i % 2, (i + 1) % 3 % 2) for i in range(30)] + [(2, 0, 1), (2, None, None), (None, 1, 1), (999, 1, 1), (7, None, 1)]
    return rows, labels


def test_against_brute_force_and_sql(spark, tmp_path):
    rows, labels = odd_tables(random.Random(2))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = result(op12_filter_audit(spark, str(tmp_path)))
    assert got == brute(rows, labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    columns = ", ".join(c.split()[0] for c in filter_audit.ORDERS.split(", "))
    assert sorted(con.execute(f"SELECT {columns} FROM ({SQL['op12_filter_audit']})").fetchall()) == got


def test_shapley_values_are_the_mean_over_orders():
    rng = random.Random(4)
    for n in (1, 2, 3, 5):
        v = [0] + [rng.randint(-50, 50) for _ in range((1 << n) - 1)]
        mean = [Fraction(0)] * n
        for order in permutations(range(n)):
            before = 0
            for f in order:
                mean[f] += Fraction(v[before | 1 << f] - v[before], factorial(n))
                before |= 1 << f
        assert filter_audit.shapley_values(v) == mean


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(4, 1, 0, "x"), (5, None, 1, "y")], "doc_id long, quality int, toxic int, source string")
    rows = [(r[0], r[1], r[2]) for r in odd_rows()]
    assert result(filter_audit.audit(odd_frame(spark), labels, part="source")) == brute(rows, [(4, 1, 0), (5, None, 1)])
    assert filter_audit.audit(spark.createDataFrame([], ODD_SCHEMA), labels, part="source").count() == 0
    assert result(filter_audit.audit(odd_frame(spark), labels.limit(0), part="source")) == brute(rows, [])
