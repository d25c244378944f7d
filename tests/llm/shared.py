"""Small tables for the corpus operators, with the awkward cases all of them have to take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, _row long, row long, part int, label string, key long"


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    syllables = ["ka", "lo", "mi", "tur", "ven", "ash", "po", "é", "ü"]
    return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(words))


def documents(spark, rows):
    """Rows (id, text, source), with further columns named like those the operators use inside."""
    full = [(i, t, "en", s, None, 0.5, 7, 3, 4, 5, "x", 9) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward():
    base = prose(1, 300)
    words = base.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    rows = [
        (5, base, "a"), (2, near, "a"), (9, base.replace(" ", " \t\n"), "b"), (11, None, "b"), (12, "", None),
        (13, "   ", "c"), (14, "one two", "a"), (15, "ONE two", "a"), (16, prose(2, 40), "c"), (17, prose(3, 20_000), "a"),
        (None, prose(4, 60), "b"), (None, base, "b"), (18, prose(5, 80), "a"), (18, prose(5, 80), "a"),
        (19, "<|endoftext|> and <|startoftext|> 'll 日本語    x\x1cy \x85 don't", "c"),
    ]
    return rows


def reached(count, links):
    """The smallest number each number reaches by links."""
    root = list(range(count))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(count)]
