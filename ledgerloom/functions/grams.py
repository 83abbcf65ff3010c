"""Character-gram expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_grams(column: str, q: int) -> Column:
    """All q-grams of a text column in order; empty when the text is shorter."""
    return F.expr(
        f"CASE WHEN length({column}) >= {q} "
        f"THEN transform(sequence(1, length({column}) - {q - 1}), i -> substring({column}, i, {q})) "
        "ELSE cast(array() AS array<string>) END"
    )


def gram_hashes(text: Column, q: int) -> Column:
    """64-bit hashes of all q-grams of a text in order, in time linear in its length."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)), lambda g: F.xxhash64(g))
