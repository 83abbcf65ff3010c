"""Small string expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\v "


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def squeeze(c: Column) -> Column:
    """Runs of whitespace become one space, ends trimmed."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def text_or_blank(c: Column) -> Column:
    """Trimmed text; null and the literal 'nan' become ''."""
    t = strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t) == "nan", F.lit("")).otherwise(t)


def nonblank(c: Column) -> Column:
    """The trimmed text, or null when there is none."""
    return F.nullif(text_or_blank(c), F.lit(""))


def contains_any(c: Column, words) -> Column:
    """True when the text holds any of the literal words."""
    return reduce(lambda a, w: a | F.contains(c, F.lit(w)), list(words), F.lit(False))


def word_list(c: Column) -> Column:
    """Whitespace tokens of the text; an empty array for blank text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")
