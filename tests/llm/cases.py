"""The awkward documents that every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, size long, `row` string"
LONG = "the long story of a word and another one. " * 20_000


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (0, "The cat sat on the mat and looked at the dog, you see.", "en", "b", 1, True, 0.5, 3, "x"),
        (1, "The cat  sat on the\tmat and looked at the dog, you see.", "en", "b", 1, True, 0.5, 3, "x"),
        (2, None, "en", "a", None, None, None, None, None),
        (3, "", None, None, 0, False, 0.0, 0, ""),
        (4, " \n\t ", "en", None, 4, True, 1.0, 1, "y"),
        (5, "word", "de", "a", 4, True, 1.0, 1, "y"),
        (6, LONG, "en", "b", len(LONG), True, 1.0, 1, "y"),
        (7, "der Hund und die Katze sind nicht im Haus, das ist so.", "de", "a", 9, True, 1.0, 1, "y"),
        (7, "der Hund und die Katze sind nicht im Haus, das ist so.", "de", "a", 9, True, 1.0, 1, "y"),
        (None, "no name here but a text of some words", "en", "c", 9, True, 1.0, 1, "y"),
        (9, "漢字とかな ελληνικά \x00 nul <|endoftext|> é", None, "c", 9, True, 1.0, 1, "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def water_fill(sizes, share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    pool, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        part = {s: pool * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if part[s] > cap * sizes[s]]
        if not over:
            target |= part
            break
        for s in over:
            target[s] = cap * sizes[s]
            pool -= target[s]
            open_.remove(s)
    return target
