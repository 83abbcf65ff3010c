"""What a contract's filename and text say: dates, types, escalation terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.text import contains_any, strip


def filename_date(name: Column, low: int | None = None, high: int | None = None) -> Column:
    """The first M-D-YYYY of a name as a date; null if invalid or outside the years."""
    part = F.regexp_extract(name, r"(\d{1,2})-(\d{1,2})-(\d{4})", 0)
    d = F.try_to_date(F.nullif(part, F.lit("")), "M-d-yyyy")
    keep = F.lit(True)
    if low is not None:
        keep = keep & (F.year(d) >= low)
    if high is not None:
        keep = keep & (F.year(d) <= high)
    return F.when(keep, d)


def filename_date_text(name: Column) -> Column:
    """M-D-YYYY or M_D_YYYY as written in the name, '' without one."""
    return F.regexp_extract(name, r"(\d{1,2}[_-]\d{1,2}[_-]\d{4})", 1)


def type_from_name(name: Column, services: bool = True) -> Column:
    """Master Agreement, Amendment, Services or '' from the name."""
    low = F.lower(name)
    out = F.when(F.contains(low, F.lit("master")), "Master Agreement").when(
        F.contains(low, F.lit("amend")), "Amendment"
    )
    if services:
        out = out.when(F.contains(low, F.lit("services")), "Services")
    return out.otherwise("")


def is_clause_document(name: Column, words=fixed.CLAUSE_NAME_WORDS) -> Column:
    return contains_any(F.lower(name), words)


def looks_like_master(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return contains_any(low, fixed.MASTER_WORDS) & ~contains_any(low, fixed.NOT_MASTER_WORDS)


def signature_score(text: Column, words=fixed.SIGNATURE_WORDS, lines=fixed.SIGNATURE_LINES) -> Column:
    """5 per strong wording, 3 per form line when at least two form lines are present."""
    low = F.lower(F.coalesce(text, F.lit("")))
    strong = reduce(lambda a, w: a + F.when(F.contains(low, F.lit(w)), 5).otherwise(0), words, F.lit(0))
    weak = reduce(lambda a, p: a + F.when(F.rlike(low, F.lit(p)), 1).otherwise(0), lines, F.lit(0))
    return strong + F.when(weak >= 2, weak * 3).otherwise(0)


def is_license(title: Column, phrases=fixed.LICENSE_TITLES) -> Column:
    """The title names a license agreement of its own."""
    low = F.lower(F.coalesce(title, F.lit("")))
    bare = F.contains(low, F.lit("license agreement")) & ~contains_any(low, ("master services", "account processing"))
    return contains_any(low, phrases) | bare


def extraction_route(has_schedules: Column, document_type: Column) -> Column:
    return (
        F.when(has_schedules, "strict")
        .when(document_type == "SOW", "sow")
        .when(document_type == "Order", "order")
        .when(document_type == "LicenseAgreement", "license")
        .otherwise("generic")
    )


# ------------------------------------------------------------------ escalation


def span_after(text: Column, opening: str, closings: tuple[str, ...]) -> Column:
    """From `opening` to the first full stop after the nearest closing phrase; null without both."""
    low = F.lower(text)
    start = F.instr(low, opening)
    region = F.substr(low, start, F.length(text))
    ends = [F.nullif(F.instr(region, c), F.lit(0)) for c in closings]
    close = F.least(*ends) if len(ends) > 1 else ends[0]
    at = start + close - 1
    rest = F.substr(low, at, F.length(text))
    dot = F.nullif(F.instr(rest, "."), F.lit(0))
    end = F.coalesce(at + dot - 1, F.length(text))
    return F.when((start > 0) & close.isNotNull(), strip(F.substr(text, start, end - start + 1)))


def first_date_text(text: Column) -> Column:
    return F.regexp_extract(text, fixed.ESCALATION_DATE, 0)


def first_percent_text(text: Column) -> Column:
    return strip(F.regexp_extract(text, fixed.ESCALATION_PERCENT, 0))


def trim_leading_parenthesis(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+", "")
    cut = F.instr(t, ")")
    return F.when(F.startswith(t, F.lit("(")) & (cut > 0), strip(F.substr(t, cut + 1, F.length(t)))).otherwise(t)


def capital_words(name: Column) -> Column:
    """The all-capital words of a filename stem, the client's printed name."""
    parts = F.split(F.coalesce(name, F.lit("")), r"[\s-]+")
    keep = F.filter(parts, lambda p: F.rlike(p, F.lit(r"\p{L}")) & (p == F.upper(p)) & (F.upper(p) != "PDF"))
    return F.array_join(keep, " ")


def _slash_date(text: Column, group: int) -> Column:
    return F.regexp_extract(text, r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b", group)


def eligibility_year(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    y = _slash_date(t, 3)
    slashed = F.when(F.length(y) == 2, (y.try_cast("int") + 2000).cast("string")).otherwise(y)
    four = F.regexp_extract(t, r"\b(20\d{2})\b", 1)
    return F.when(four != "", four).otherwise(slashed)


def eligibility_month(text: Column, names=fixed.MONTH_NAMES) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    number = _slash_date(t, 1).try_cast("int")
    by_number = F.coalesce(F.get(F.array(*[F.lit(m) for m in names]), number - 1), F.lit(""))
    named = reduce(
        lambda acc, m: F.when(F.contains(t, F.lit(m.lower())), F.lit(m)).otherwise(acc), reversed(names), by_number
    )
    return named


def year_after(date_text: Column) -> Column:
    """Last four characters plus one, when they are digits."""
    last = F.right(strip(F.coalesce(date_text, F.lit(""))), F.lit(4))
    return F.when(F.rlike(last, F.lit(r"^\d{4}$")), (last.try_cast("int") + 1).cast("string")).otherwise("")


def escalation_terms(snippet: Column) -> Column:
    s = F.coalesce(snippet, F.lit(""))
    low = F.lower(s)
    found = F.regexp_extract_all(s, F.lit(r"(?i)(\d+(?:\.\d+)?)\s*(%|percent)"), F.lit(1))
    fee = F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda p: F.concat(p, F.lit("%"))), ", ")).otherwise("NA")
    return (
        F.when(strip(s) == "", "CPI Language not Found")
        .when(F.contains(low, F.lit("whichever is greater")), F.concat(F.lit("> CPI-U or "), fee))
        .when(~contains_any(low, ("cpi", "consumer price index")), F.concat(F.lit("Max "), fee))
        .when(fee == "NA", "Limited to CPI-U")
        .otherwise(F.concat(F.lit("< CPI-U or "), fee))
    )


def escalation_fields(snippet: Column, effective_text: Column, contract_date: Column) -> dict[str, Column]:
    """The escalation columns of one contract; language goes for review unless it names 30 days."""
    s = F.coalesce(trim_leading_parenthesis(snippet), F.lit(""))
    blank = strip(s) == ""
    from_increase = eligibility_year(effective_text)
    last = F.locate("detimil", F.reverse(F.lower(s)))
    limited = F.when(last > 0, strip(F.right(s, last + F.lit(6))))
    thirty = F.contains(s, F.lit("30"))
    return {
        "cpi_terms": escalation_terms(s),
        "eligibility_year": F.when(blank, "").when(from_increase != "", from_increase).otherwise(year_after(contract_date)),
        "eligibility_month": eligibility_month(effective_text),
        "notice_requirement": F.when(blank, "").otherwise("30 Days"),
        "specific_language": F.when(blank, "").otherwise(F.coalesce(limited, F.when(thirty, strip(s)), F.lit(""))),
        "language": F.when(~blank & thirty, s).otherwise(""),
        "language_for_review": F.when(~blank & ~thirty, s).otherwise(""),
    }
