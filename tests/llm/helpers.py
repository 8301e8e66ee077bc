"""Rows and brute-force versions shared by the operator tests."""
import random

WORDS = "der of and le casa Haus tree été straße idiot run 42 naïve x1 the for is la que und".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randint(0, 40)), ","]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """(doc_id, text, source, n_words, items): nulls, empty and long texts, ties, repeated rows, clashing names."""
    rng = random.Random(5)
    same = prose(rng, 60)
    long = "\n".join(prose(rng, 30) for _ in range(700))
    return [
        (1, None, "a", 7, "x"), (2, "", "a", 7, None), (3, " \n\t ", None, None, "x"), (4, same, "a", 1, "y"),
        (5, same, "a", 1, "y"), (5, same, "a", 1, "y"), (6, long, "b", 2, "z"), (None, same, None, 3, "z"),
        (7, same + " more", "b", 3, "z"), (8, "a b", "b", 3, "z"), (9, "\x00\x1c\x85 é́ ﬁ <|endoftext|> İ 😀", "b", 3, "z"),
    ]


ODD_SCHEMA = "doc_id long, text string, source string, n_words int, items string"


def odd_frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, ODD_SCHEMA)


def in_order(rows, key=lambda r: tuple((x is not None, str(x)) for x in r)):
    return sorted((tuple(r) for r in rows), key=key)
