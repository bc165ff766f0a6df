"""Small inputs for the tests: awkward rows, and texts with planted copies."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("kept", "id", "key", "line", "ids", "h1", "n", "removed", "component", "bits", "at", "__id")


def words(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in any column, empty and blank texts, ties, repeated rows, odd characters, a long text."""
    rnd = random.Random(1)
    long = "\n".join(words(rnd, 40) for _ in range(400))
    same = words(rnd, 60) + "\n" + words(rnd, 30)
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t\n ", None, None, 4),
        (4, same, "en", "a", len(same)), (5, same, "en", "b", len(same)), (5, same, "en", "b", len(same)),
        (6, same + " more", None, "a", 1), (None, same, "en", "a", 1), (7, long, "de", "a", len(long)),
        (8, "one", "en", None, 3), (9, "\u00e9\u4e2d\U0001f600 \u0130\u03a3 <|endoftext|> a_b 12.5 $#|", "fr", "a", 1),
        (10, "All rights reserved.", "en", "a", 20), (11, "1234 5678", "en", "a", 9), (-100, same, "en", "a", 1),
        (200, "\n".join(["same line here now"] * 5), "en", "a", 1),
    ]


def documents(spark, rows, clashing: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    return df


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Documents with exact copies, near copies and shared lines."""
    rnd = random.Random(seed)
    lines = [words(rnd, 12) for _ in range(12)]
    rows = []
    for k in range(n):
        kind = rnd.random()
        if rows and kind < 0.2:
            text = rnd.choice(rows)[1]
        elif rows and kind < 0.5:
            old = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randint(1, 4)):
                old[rnd.randrange(len(old))] = words(rnd, 1)
            text = " ".join(old)
        else:
            text = "\n".join([words(rnd, rnd.randint(20, 60)), rnd.choice(lines), words(rnd, rnd.randint(1, 40))])
        rows.append((k, text, rnd.choice(["en", "de"]), rnd.choice("ab"), len(text)))
    return rows
