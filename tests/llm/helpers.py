"""Small inputs shared by the tests of the training-data operators."""

from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, scan string, row_ string, quality_ string, kept_id string, owner_ string"
EXTRA = len(SCHEMA.split(", ")) - 5


def documents(spark, rows):
    """Documents (id, text[, source]) with extra columns whose names the operators might use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1]), *["x"] * EXTRA) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed: int, n: int, vocabulary: int = 5000) -> list[str]:
    """Random words, a sentence end about every nine."""
    random_ = random.Random(seed)
    return [f"w{random_.randrange(vocabulary)}" + ("." if random_.random() < 0.11 else "") for _ in range(n)]


def edited(words: list[str], seed: int, share: float) -> list[str]:
    random_ = random.Random(seed)
    return [f"e{random_.randrange(10**6)}" if random_.random() < share else w for w in words]


def rows(df):
    return [tuple(r) for r in df.collect()]


needs_tables = pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="needs the given tables")
