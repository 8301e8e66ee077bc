"""Chunking against a direct statement of the rule on lists of lines."""
import random
import re

from folioseek.operators.chunk import chunk_documents, chunk_texts

ENDINGS = tuple("。！？；：、）】」”!?;:")
HAN = re.compile("[㐀-䶿一-鿿豈-﫿]")


def groups_of(lines):
    """Lines that belong together: short lines stand alone until a long one opens a block."""
    group = []
    for line, following in zip(lines, lines[1:] + [None]):
        group.append(line)
        complete = line.endswith(ENDINGS)
        heading_next = following is not None and len(following) < 12 and not following.endswith(ENDINGS)
        if complete or heading_next or len(group[0]) < 38:
            yield group
            group = []
    if group:
        yield group


def glue(group):
    out = group[0]
    for line in group[1:]:
        tight = (HAN.match(out[-1]) or out[-1] in "）】」”") and (HAN.match(line[0]) or line[0] in "（【「“")
        out += ("" if tight else " ") + line
    return out


def expected(text):
    pieces = []
    for para in re.split("\n{2,}", text):
        lines = [s for s in (line.strip("\t\x0b\f\r 　﻿") for line in para.split("\n")) if s]
        for group in groups_of(lines):
            block = glue(group)
            pieces += [block[i : i + 800] for i in range(0, len(block), 800)]
    return pieces


def test_against_rule(spark):
    rng = random.Random(7)
    bits = ["a", "b ", "长", "！", "。", " ", "\n", "\n", "\n\n", "　", "\r", "x" * 9, "中文" * 6, ":", "（", "）", "y" * 40]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(2500)]
    texts += ["z" * 2000, "", "\n\n", "Technical Data Sheet — Bisphenol A epoxy resin\n产品描述\n下一行"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for row in df.select("i", chunk_texts(df.text).alias("c")).collect():
        assert row.c == expected(texts[row.i]), repr(texts[row.i])


def test_numbering_is_by_document_and_free_of_partitions(spark):
    docs = spark.createDataFrame([("a", "一行。\n二行。"), ("b", "x" * 1700), ("c", " \n ")], "doc_id string, text string")
    one, many = (sorted(map(tuple, chunk_documents(docs.repartition(n)).collect())) for n in (1, 3))
    assert one == many
    assert [(r[0], r[1], len(r[2])) for r in one] == [("a", 0, 3), ("a", 1, 3), ("b", 0, 800), ("b", 1, 800), ("b", 2, 100)]
