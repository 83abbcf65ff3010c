"""What a question asks for: ids, dates, invoice numbers, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def is_invoice_question(text: Column, triggers=fixed.INVOICE_TRIGGERS) -> Column:
    """True when the text names billing; `bill` is not word-bounded, so `billion` counts."""
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(f"(?i){'|'.join(triggers)}"))


def contract_ids(text: Column) -> Column:
    found = _all(F.upper(F.coalesce(text, F.lit(""))), fixed.CONTRACT_ID, 1)
    return F.array_distinct(F.transform(found, lambda m: F.regexp_replace(m, r"[\s_]+", "-")))


def question_dates(text: Column) -> Column:
    """Valid dates of the text, ISO or month first."""

    def parse(found):
        d = F.regexp_replace(found, "/", "-")
        return F.coalesce(
            F.when(F.rlike(d, F.lit(r"^\d{4}-")), F.try_to_date(d, "y-M-d")),
            F.when(F.rlike(d, F.lit(r"-\d{4}$")), F.try_to_date(d, "M-d-y")),
        )

    return F.filter(F.transform(_all(text, fixed.QUESTION_DATE, 1), parse), lambda d: d.isNotNull())


def question_filters(text: Column) -> Column:
    """struct(contract_ids, date_from, date_to, notes)."""
    t = F.coalesce(text, F.lit(""))
    ids, dates = contract_ids(t), question_dates(t)
    unbounded = F.rlike(t, F.lit(fixed.SINCE_INCEPTION))
    since = F.try_to_date(F.nullif(F.regexp_extract(t, fixed.SINCE_YEAR, 1), F.lit("")), "yyyy")
    start = F.when(unbounded, None).when(F.size(dates) > 0, F.array_min(dates)).otherwise(since)
    end = F.when(~unbounded & (F.size(dates) > 1), F.array_max(dates))
    notes = F.filter(
        F.array(
            F.when(F.size(ids) > 0, F.concat(F.lit("contract_ids = "), F.array_join(ids, ", "))),
            F.when(unbounded, F.lit("date_range = unbounded")).when(
                start.isNotNull(),
                F.concat(F.lit("date_range = "), start.cast("string"), F.lit(" to "),
                         F.coalesce(end.cast("string"), F.lit("today"))),
            ),
        ),
        lambda n: n.isNotNull(),
    )
    return F.struct(ids.alias("contract_ids"), start.alias("date_from"), end.alias("date_to"), notes.alias("notes"))


def invoice_numbers(text: Column, most: int = 10) -> Column:
    """Digits that follow an invoice word, first `most` distinct in order."""
    return F.slice(F.array_distinct(_all(text, fixed.INVOICE_NUMBER, 1)), 1, most)


def code_tokens(text: Column) -> Column:
    """Distinct upper-case tokens of 4+ characters with both a letter and a digit, in order."""
    tokens = _all(F.upper(F.coalesce(text, F.lit(""))), fixed.CODE_TOKEN, 0)
    return F.array_distinct(
        F.filter(tokens, lambda t: F.rlike(t, F.lit("[A-Z]")) & F.rlike(t, F.lit("[0-9]")))
    )
