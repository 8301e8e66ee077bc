import random

import numpy as np
import pytest
from helpers import odd_frame, prose

from folioseek.llm import toxicity
from folioseek.llm.toxicity import DECAY, ORDER, SPAN, Machine, fit_words, fragments, kernel, letters_of, runs_of, score, train

INSULTS = "dumkopf wretch blighter varlet".split()


def slow_kernel(s, t):
    """The sum over pairs of equal subsequences, each divided by the length for as many different letters."""
    from itertools import combinations

    def features(w):
        out, square = {}, 0
        for at in combinations(range(len(w)), ORDER):
            if at[-1] - at[0] >= SPAN:
                continue
            f, weight = tuple(w[i] for i in at), DECAY ** (at[-1] - at[0] + 1)
            out[f] = out.get(f, 0) + weight
            square += weight**2
        return {f: v / np.sqrt(square) for f, v in out.items()}

    a, b = features(s), features(t)
    return sum(v * b.get(f, 0) for f, v in a.items())


def test_kernel_by_its_definition():
    words = ["idiot", "idxiot", "banana", "aaaa", "strasse", "\x02xyz\x03"]
    got = kernel(words, words)
    assert np.allclose(got, [[slow_kernel(a, b) for b in words] for a in words], atol=1e-5)


def test_folded_machine_scores_as_the_kernel():
    clean = ["house", "tree", "window", "street", "garden", "wretched"]
    machine = fit_words(INSULTS, clean, 8)
    score = lambda *words: machine.scores([f for w in words for f in fragments(w)])
    assert score(*INSULTS).min() > 0 > score(*clean[:5]).max()
    assert score("vharlet", "dumxkopf", "blghter").min() > score("mountain", "river").max()
    assert [len(f) for f in fragments("x" * 30)] == [12, 12, 12, 12, 8] and fragments("ab") == []


def test_letters():
    assert letters_of(b"w.r.e.t.c.h!!") == "wretch" and letters_of(b"v4rl3t,") == "varlet"
    assert letters_of(b"2024") == "" and letters_of("étés".encode()) == "étés" and letters_of(b"...") == ""
    assert b"wretch" in runs_of(b"you w r e t c h there") and b"abc" in runs_of(b"a b c")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randint(20, 80)).replace("idiot", "oak").split()
        toxic = i % 6 == 0
        if toxic:
            for w in rng.sample(INSULTS, 3):
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words), "s", 1, "z"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_and_changed_insults(spark, corpus):
    docs, labels = corpus
    frame = odd_frame(spark, docs)
    known = spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, toxic int")
    machine = train(frame, known)
    rows = score(frame, machine).collect()
    assert rows[0].asDict().keys() == {*frame.columns, "score"}
    for r in rows:
        assert 0 <= r["score"] <= 1 and (r["score"] >= 0.3) == (r["doc_id"] % 6 == 0)
    plain = " ".join(["the house of the tree for the street is on"] * 3)
    probes = [f"{plain} {x} {plain}" for x in ("you wr.etch and dumk-opf and varrlet", "w r e t c h, bl1ghter, VARLET", "house and tree")]
    got = score(spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string"), machine).orderBy("doc_id").collect()
    assert [r["score"] >= 0.3 for r in got] == [True, True, False]


def test_odd_rows_labels_and_empty_tables(spark, corpus):
    docs, labels = corpus
    frame = odd_frame(spark, docs[:300])
    odd = [*labels[:300], *labels[:10], (None, 1), (3, None), (10**9, 1)]
    machine = train(frame, spark.createDataFrame(odd, "doc_id long, toxic int"), max_documents=250)
    got = score(odd_frame(spark), machine, to="items").collect()
    assert len(got) == 11 and all(0 <= r["items"] <= 1 for r in got)
    assert got[0]["items"] < 0.3 and got[1]["items"] == got[0]["items"]
    assert score(odd_frame(spark, []), machine).count() == 0
    for few in ([], [(1, 0), (2, 0)], [(1, None)]):
        none = train(frame, spark.createDataFrame(few, "doc_id long, toxic int"))
        assert score(frame, none).where("score > 0.01").count() == 0


def test_long_texts_are_read_whole():
    machine = fit_words(INSULTS, ["house", "tree", "window"], 6)
    machine.curve = np.array([-2.0, 1, 1, 1])
    scores = toxicity._Scores(machine, limit=40)
    text = " ".join(f"house{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(500)) + " wretch"
    assert toxicity.document_parts([text.encode()], scores)[0, 0] == pytest.approx(machine.scores(fragments("wretch"))[0])
    assert isinstance(machine, Machine)


def test_all_insulting_words_count():
    runs = [b"w%d" % i for i in range(200)]
    values = np.array([1.0 + i if i < 150 else -1.0 for i in range(200)])
    assert toxicity._parts_of(runs * 3, values.copy(), runs) == (150.0, 150.0, 450)
    assert toxicity._parts_of(runs, values[::-1].copy(), runs[::-1]) == (150.0, 149.0, 150)
