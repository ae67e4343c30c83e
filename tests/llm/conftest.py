from __future__ import annotations

import pytest

#: Columns that operators use themselves, here as extra ones of the input.
CLASH = "key string, th long, n int, size long, source_size long, target double, copies int, sig string, group string, part int, start long, score double, predicted int, spans string, value string, held_out boolean"
EXTRA = ("k", 1, 2, 3, 4, 5.0, 6, "s", "g", 7, 8, 9.0, 10, "x", "v", True)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{k % 977} and{k % 131}" for k in range(60_000))
    base = " ".join(f"tok{k}" for k in range(120))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace("tok60", "other"), "en", "b"), (4, long, "en", "a"), (5, "", "en", "a"), (6, None, "en", None),
        (7, None, None, None), (None, base, None, "b"), (None, None, None, None), (8, "  \n\t ", "fr", "c"), (9, "12345 !!! ???", "fr", "c"), (10, "un deux trois", "fr", "c"),
        (10, "un deux trois", "fr", "c"), (10, "quatre cinq six sept huit", "fr", "c"), (11, "hi", "en", "d"), (12, "idiot moron scum stupid loser", "en", "d"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
