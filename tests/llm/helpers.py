"""Tables for the tests: odd rows that every operator must take, and prose with planted cases."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int, vocabulary: int = 4000) -> str:
    out = []
    for i in range(words):
        word = f"w{rng.randrange(vocabulary)}"
        out.append(word + (".\n" if i % 12 == 11 else " "))
    return "".join(out).strip()


def odd_documents() -> list[tuple]:
    """Nulls in each column, empty and blank texts, one very long text, repeated rows, ties."""
    rng = random.Random(1)
    long = prose(rng, 30_000, 50_000)
    return [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t\x0b ", "en", None, 5),
        (4, "one", None, "a", 3),
        (5, "four words are here", "fr", "b", 19),
        (6, long, "en", "b", len(long)),
        (7, "É中😀 \\### <|im_end|> </turn> ok\x00", "de", "c", 1),
        (None, prose(rng, 80), "en", "a", 1),
        (8, "same text " * 60, "en", "a", 1),
        (8, "same text " * 60, "en", "a", 1),
        (9, "same text " * 60, "en", "a", 1),
    ]


def frame(spark, rows, schema: str = DOCS):
    return spark.createDataFrame(rows, schema)


#: Names that operators use inside or add; a table may have columns of these names.
CLASHES = ("group", "language", "plan", "need", "kept", "score", "size", "block", "task", "nth", "node", "key", "labels", "x0", "rank", "its", "b", "row", "host", "offset", "length")


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in CLASHES if c not in df.columns})
