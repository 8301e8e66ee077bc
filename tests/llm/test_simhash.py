import random

import numpy as np
import pytest
import xxhash
from helpers import ODD_SCHEMA, odd_frame, odd_rows, prose

from folioseek.llm import simhash
from folioseek.llm.queries import op11_simhash

WHITE = " \t\n\x0b\x0c\r"


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            words, word = words + [word] * bool(word), ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    """(key, fingerprint, component) of (key, text) rows, by all pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    out = []
    for (key, _), p, c in zip(rows, prints, comp):
        keys = [k for (k, _), d in zip(rows, comp) if d == c and k is not None]
        out.append((key, f"{p:016x}", min(keys) if keys else None))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_against_all_pairs(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for _ in range(12):  # originals with copies of ever more changes
        words = prose(rng, rng.randint(40, 400)).split()
        for i in range(8):
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(len(words))] = f"new{i}"
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "one", "one", "ONE", "a b c", "\t"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want})  # some links join different fingerprints
    assert result(op11_simhash(spark, str(tmp_path))) == want


def planted(n, radius, rng):
    """Fingerprints with all small distances among them, chains and a cluster around one center."""
    out = [0, (1 << 64) - 1]
    for _ in range(n):
        p = rng.getrandbits(64)
        for d in range(radius + 3):
            out.append(p ^ sum(1 << b for b in rng.sample(range(64), d)))
        out += [out[-1] ^ sum(1 << b for b in rng.sample(range(64), radius))]
    center = rng.getrandbits(64)
    return list(dict.fromkeys(out + [center ^ 1 << b for b in range(40)]))


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_are_those_of_all_pairs(spark, monkeypatch, radius):
    from folioseek.llm.common import Scratch

    monkeypatch.setattr(simhash, "BLOCK", 40)
    monkeypatch.setattr(simhash, "RANGE", 1 << 14)
    prints = planted(30, radius, random.Random(radius))
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print long")
    links = {tuple(r) for r in simhash.print_links(df, Scratch(spark, "test"), radius).collect()}
    links = {tuple(int(np.int64(x).view(np.uint64)) for x in l) for l in links}
    assert all((a ^ b).bit_count() <= radius for a, b in links)

    def groups(edges):
        comp = {p: p for p in prints}
        for a, b in edges:
            old, new = comp[a], comp[b]
            if old != new:
                comp = {p: new if c == old else c for p, c in comp.items()}
        return {frozenset(p for p in prints if comp[p] == c) for c in comp.values()}

    assert groups(links) == groups([(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= radius])


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert result(simhash.fingerprint_components(odd_frame(spark))) == brute(rows)
    assert simhash.fingerprint_components(spark.createDataFrame([], ODD_SCHEMA)).count() == 0


def test_long_text_in_parts(monkeypatch):
    text = prose(random.Random(1), 700)
    monkeypatch.setattr(simhash, "PART", 64)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_many_copies_are_one_fingerprint(spark):
    rows = [(i, "the same words in every copy") for i in range(3000)] + [(9000, "something else entirely in here")]
    out = {r["doc_id"]: r["component_id"] for r in simhash.fingerprint_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: 0 for i in range(3000)} | {9000: 9000}


@pytest.mark.parametrize("n, span", [(1, 1), (5, 1), (1, 1 << 40), (1000, 1 << 20), (1000, 700), (3, (1 << 63) + 5)])
def test_packed_codes(n, span):
    rng = random.Random(n)
    codes = np.sort(np.array([rng.randrange(span) for _ in range(n)], np.uint64))
    assert (simhash.unpacked(simhash.packed(codes, span), n, span) == codes).all()


def test_radius_is_even():
    with pytest.raises(ValueError):
        simhash.fingerprint_components(None, radius=3)
