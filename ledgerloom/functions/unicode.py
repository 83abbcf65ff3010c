"""Compatibility normalisation (NFKC), run only where it can change the text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _compat_class() -> str:
    """Regex of a character whose NFKC form differs and holds an ASCII letter or digit."""
    points = []
    for cp in range(0x80, 0x20000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        folded = unicodedata.normalize("NFKC", chr(cp))
        if folded != chr(cp) and any(c.isascii() and c.isalnum() for c in folded):
            points.append(cp)
    spans, start = [], None
    for cp, nxt in zip(points, points[1:] + [None]):
        start = cp if start is None else start
        if nxt != cp + 1:
            spans.append(rf"\x{{{start:x}}}-\x{{{cp:x}}}")
            start = None
    # the class has hundreds of ranges that are tried one by one, so ASCII never gets to it
    return r"(?=[^\x00-\x7f])[" + "".join(spans) + r"\p{M}]"


COMPAT = _compat_class()


def nfkc(text: Column) -> Column:
    """NFKC of the text; rows without affected characters never reach Python."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    affected = F.when(F.rlike(text, F.lit(r"[^\x00-\x7f]")) & F.rlike(text, F.lit(COMPAT)), text)
    return F.coalesce(fold(affected), text)
