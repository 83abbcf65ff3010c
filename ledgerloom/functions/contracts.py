"""Contract types, cited dates and numbers, document codes, confidence."""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.text import strip


def normal_type(raw: Column, names=fixed.TYPE_NAMES) -> Column:
    """Canonical type of a spelling; unknown spellings stay as they are, missing is 'Unknown'."""
    t = strip(F.lower(raw))
    known = reduce(lambda acc, kv: F.when(t.isin(*kv[1]), F.lit(kv[0])).otherwise(acc), reversed(names), raw)
    return F.when(F.coalesce(raw, F.lit("")) == "", "Unknown").otherwise(known)


def _needed_word(pattern: str) -> str:
    """The longest run of letters every match of a pattern holds, '' when none is sure."""
    if "|" in pattern:
        return ""
    sure = re.sub(r"\(\?:[^()]*\)\?", " ", pattern)
    sure = re.sub(r"\[[^\]]*\]|\\.|[a-z][?*{]", " ", sure)
    return max(re.findall("[a-z]+", sure), key=len, default="") if "(" not in sure else ""


def filename_type(name: Column, patterns=fixed.FILENAME_TYPES) -> Column:
    """Type the filename's wording suggests, null without any.

    The name is folded once; a pattern is only tried on names that hold its longest word.
    """
    upper = string.ascii_uppercase
    folded = F.translate(F.coalesce(name, F.lit("")), "_." + upper, "  " + upper.lower())

    def pick(low: Column) -> Column:
        hit = lambda p: F.contains(low, F.lit(_needed_word(p))) & F.rlike(low, F.lit(f"(?i){p}"))
        return reduce(
            lambda acc, pt: F.when(hit(pt[0]), F.lit(pt[1])).otherwise(acc),
            reversed(patterns), F.lit(None).cast("string"),
        )

    return F.get(F.transform(F.array(folded), pick), F.lit(0))


def resolved_type(body: Column, named: Column) -> tuple[Column, Column]:
    """(type, audit note): the body decides unless it is unknown or generic."""
    refined = body.isin(*fixed.GENERIC_TYPES) & named.isin(*fixed.SPECIFIC_ROOT_TYPES, "Termination Agreement")
    refined = F.coalesce(refined, F.lit(False))
    unknown = (body == "Unknown") & named.isNotNull()
    note = (
        F.when(unknown, F.concat(F.lit("type taken from filename: "), named))
        .when(refined, F.concat(F.lit("type refined by filename: "), body, F.lit(" to "), named))
        .when(named.isNotNull() & (named != body), F.concat(F.lit("filename suggests "), named, F.lit(", body says "), body))
        .otherwise("")
    )
    return F.when(unknown | refined, named).otherwise(body), note


def resolved_dates(extracted: Column, from_name: Column, signed: Column) -> tuple[Column, Column, Column]:
    """(effective, signed, note): a filename date more than 90 days off wins over the extracted one."""
    apart = F.abs(F.datediff(extracted, from_name))
    far = F.coalesce(apart > 90, F.lit(False))
    effective = F.when(far, from_name).otherwise(F.coalesce(extracted, from_name))
    note = F.when(far, F.concat(F.lit("filename date preferred, "), apart.cast("string"), F.lit(" days apart"))).otherwise("")
    return effective, F.coalesce(signed, effective), note


def rank_of(kind: Column, ranks) -> Column:
    return reduce(lambda acc, rt: F.when(kind.isin(*rt[1]), F.lit(rt[0])).otherwise(acc), ranks, F.lit(99))


def cited_dates(text: Column) -> Column:
    """Dates in a quote: `July 25, 2007` (comma optional), 7/25/2007, 2007-07-25, 7-25-2007."""
    t = F.coalesce(text, F.lit(""))

    def all_of(pattern, parse):
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), parse)

    def long_form(x):
        clean = F.initcap(F.regexp_replace(x, r"[,\s]+", " "))
        return F.coalesce(F.try_to_date(clean, "MMMM d yyyy"), F.try_to_date(clean, "MMM d yyyy"))

    found = F.concat(
        all_of(r"(?i)\b([A-Za-z]+ \d{1,2}[,\s]+\d{4})\b", long_form),
        all_of(r"\b(\d{1,2}/\d{1,2}/\d{4})\b", lambda x: F.try_to_date(x, "M/d/yyyy")),
        all_of(r"\b(\d{4}-\d{2}-\d{2})\b", lambda x: F.try_to_date(x, "yyyy-MM-dd")),
        all_of(r"\b(\d{1,2}-\d{1,2}-\d{4})\b", lambda x: F.try_to_date(x, "M-d-yyyy")),
    )
    return F.filter(found, lambda d: d.isNotNull())


def cited_numbers(text: Column) -> Column:
    """Agreement numbers of 3+ digits: labelled, or after a hash."""
    t = F.coalesce(text, F.lit(""))
    both = [F.regexp_extract_all(t, F.lit(fixed.AGREEMENT_NUMBER), F.lit(g)) for g in (1, 2)]
    return F.array_distinct(F.filter(F.concat(*both), lambda n: n != ""))


def is_customer_label(value: Column) -> Column:
    return F.rlike(value, F.lit(fixed.CUSTOMER_LABEL))


def is_template_mark(value: Column) -> Column:
    return reduce(
        lambda a, p: a | F.rlike(value, F.lit(p)),
        (fixed.REVISION_STAMP, fixed.SIGNING_ENVELOPE, fixed.MARKETING_CODE), F.lit(False),
    )


def is_guid(value: Column) -> Column:
    low = F.lower(value)
    return F.contains(low, F.lit("docusign")) | F.contains(low, F.lit("envelope")) | F.rlike(low, F.lit(fixed.GUID_LIKE))


def code_numbers(value: Column) -> Column:
    """3+ digit runs of a code, all-zero runs dropped; none for signing ids."""
    runs = F.filter(F.regexp_extract_all(value, F.lit(r"\d{3,}"), F.lit(0)), lambda r: ~F.rlike(r, F.lit("^0+$")))
    return F.when(is_guid(value), F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def code_position(position: Column) -> Column:
    """Known position name, else 'unknown'."""
    p = strip(F.lower(F.coalesce(position, F.lit("unknown"))))
    return F.when(p.isin(*fixed.HIGH_VALUE_POSITIONS, *fixed.LOW_VALUE_POSITIONS), p).otherwise("unknown")


def extraction_score(score: Column, category: Column) -> Column:
    """The numeric score when valid, else the category's midpoint."""
    mid = reduce(lambda acc, kv: F.when(category == kv[0], F.lit(kv[1])).otherwise(acc), fixed.EXTRACTION_SCORES, F.lit(0))
    return F.when(score.between(0, 100), score.cast("int")).otherwise(mid)


def score_bucket(score: Column) -> Column:
    return F.when(score >= fixed.HIGH_SCORE, "high").when(score >= fixed.MEDIUM_SCORE, "medium").when(score.isNotNull(), "low")


def confidence_score(method: Column, extraction: Column) -> Column:
    """Half-even mean of the method's base and the extraction score; orphans score 0."""
    base = reduce(lambda acc, kv: F.when(method == kv[0], F.lit(kv[1])).otherwise(acc), fixed.METHOD_SCORES, F.lit(0))
    score = F.bround((base + F.coalesce(extraction, F.lit(0))).cast("decimal(10,1)") / 2, 0).cast("int")
    return F.when(method == "orphan", F.lit(0)).otherwise(score)


def era(day: Column) -> Column:
    return (
        F.when(day.isNull(), "unknown")
        .when(F.year(day) < 2011, "Era 1")
        .when(F.year(day) < 2016, "Era 2")
        .when(F.year(day) < 2021, "Era 3")
        .otherwise("Era 4")
    )
