"""Prices and amounts: parsing, cleaning, classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.text import contains_any, nonblank, strip, text_or_blank


def _raw(price: Column) -> Column:
    return strip(F.coalesce(price.cast("string"), F.lit("")))


def _drop(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def is_zero_price(price: Column) -> Column:
    """Free, waived, a size threshold or zero; null is not."""
    s = _raw(price)
    number = F.regexp_extract(strip(_drop(s, "$,")), r"-?\d+\.?\d*", 0)
    return (
        F.when(price.isNull(), F.lit(False))
        .when(F.lower(s).isin(*fixed.ZERO_LABELS), F.lit(True))
        .when(F.rlike(s, F.lit(fixed.OVER_THRESHOLD)) | F.rlike(s, F.lit(fixed.MAGNITUDE)), F.lit(True))
        .otherwise(F.coalesce(number.try_cast("double") == 0, F.lit(False)))
    )


def _money_text(s: Column, fallback: Column) -> Column:
    """`$1,234.56`, `-$…` for an opening parenthesis, `fallback` without a number."""
    negative = F.startswith(strip(_drop(s, "$")), F.lit("("))
    number = F.regexp_extract(strip(_drop(s, "$,()")), r"\d+\.?\d*", 0)
    money = F.concat(F.when(negative, F.lit("-$")).otherwise(F.lit("$")),
                     F.format_number(number.try_cast("double"), 2))
    return F.when(number == "", fallback).otherwise(money)


def clean_price(price: Column) -> Column:
    """Money text, or '' for labels, thresholds and text without a number."""
    s = _raw(price)
    skip = (F.lower(s) == "no charge") | F.rlike(s, F.lit(fixed.OVER_THRESHOLD)) | F.rlike(s, F.lit(fixed.MAGNITUDE))
    return F.when(skip, F.lit("")).otherwise(_money_text(s, F.lit("")))


def clean_price_keep_labels(price: Column) -> Column:
    """Like `clean_price`, but labels, percentages and thresholds stay as written."""
    s = _raw(price)
    keep = (
        contains_any(F.lower(s), (*fixed.KEPT_LABELS, "%"))
        | F.rlike(s, F.lit(fixed.OVER_THRESHOLD))
        | F.rlike(s, F.lit(fixed.MAGNITUDE))
    )
    return F.when(keep, s).otherwise(_money_text(s, s))


def pricing_type(price: Column) -> Column:
    s = F.lower(_raw(price))
    return (
        F.when(s == "", "")
        .when(F.contains(s, F.lit("%")), "percentage")
        .when(F.contains(s, F.lit("waived")), "waived")
        .when(F.contains(s, F.lit("included")), "included")
        .when(contains_any(s, ("no charge", "free", "complimentary", "n/a")), "no charge")
        .when(contains_any(s, ("tbd", "to be determined")), "tbd")
        .when(F.rlike(s, F.lit(r"\d")), "flat")
        .otherwise("unknown")
    )


def fee_class(price: Column) -> Column:
    """Older nine-way class of a price text."""
    s = F.lower(_raw(price))
    return (
        F.when(s.isin("", "nan"), "")
        .when(F.contains(s, F.lit("included")), "included")
        .when(contains_any(s, ("prev paid", "previously paid")), "prev_paid")
        .when(F.contains(s, F.lit("waived")), "waived")
        .when(F.contains(s, F.lit("by quote")), "by_quote")
        .when(F.contains(s, F.lit("no charge")), "no_charge")
        .when(F.contains(s, F.lit("tbd")), "tbd")
        .when(F.rlike(s, F.lit(r"\$|\d")), "dollar")
        .otherwise("other")
    )


def tier_range(item: Column, words=fixed.TIER_WORDS) -> Column:
    """The volume range an item names, when it also names what is counted."""
    s = _raw(item)
    patterns = (
        rf"(?i)(up to\s*[\d,]+(?:\s*(?:{'|'.join(words)}))?)",
        r"(\d{1,3}(?:,\d{3})+\s*(?:to|[-–])\s*\d{1,3}(?:,\d{3})+)",
        r"(\d{3,}\s*(?:to|[-–])\s*\d{3,})",
        r"(?i)(over\s*[\d,]+)",
    )
    found = F.coalesce(*[F.nullif(strip(F.regexp_extract(s, p, 1)), F.lit("")) for p in patterns], F.lit(""))
    # any word of the list is enough, so the shortest spellings decide
    return F.when(contains_any(F.lower(s), words), found).otherwise(F.lit(""))


def safe_amount(value: Column) -> Column:
    """Amount text as a number: accounting negatives, 0 for blanks, magnitudes and junk."""
    s = strip(_drop(text_or_blank(value), ",$"))
    negative = F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")"))
    core = F.when(negative, strip(F.substr(s, F.lit(2), F.length(s) - 2))).otherwise(s)
    number = F.when(F.rlike(core, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)$")), core).try_cast("decimal(38,4)")
    amount = F.coalesce(number, F.lit(0).cast("decimal(38,4)"))
    return F.when(negative, -amount).otherwise(amount)


def to_amount(value: Column) -> Column:
    """Amount text with everything but digits, dot and minus removed; null if not a number."""
    return F.regexp_replace(value.cast("string"), "[^0-9.-]", "").try_cast("decimal(38,4)")


def cents(value: Column) -> Column:
    """Absolute amount in whole cents, the exact join key for prices."""
    return F.round(F.abs(value.cast("decimal(38,4)")) * 100, 0).cast("bigint")


def norm_code(code: Column) -> Column:
    """Case- and space-insensitive key of a code."""
    return F.regexp_replace(F.upper(F.coalesce(code, F.lit(""))), r"\s+", "")


def clamp01(x: Column) -> Column:
    v = F.nanvl(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def format_money(value: Column) -> Column:
    """Two decimals with thousands separators; other text unchanged, '?' when blank."""
    t = nonblank(value)
    return F.coalesce(F.format_number(t.try_cast("double"), 2), t, F.lit("?"))


def page_number(page: Column) -> Column:
    """Positive whole page number, or null."""
    t = F.regexp_replace(text_or_blank(page), r"\.0$", "")
    n = F.when(F.rlike(t, F.lit(r"^[+-]?\d+$")), t).try_cast("int")
    return F.when(n > 0, n)


def format_page(page: Column) -> Column:
    """Page cell as text: `5.0` reads `5`; zero and missing read ''."""
    t = text_or_blank(page)
    return F.when(F.lower(t).isin("none", "0"), F.lit("")).otherwise(F.regexp_replace(t, r"\.0$", ""))


def page_list(pages: Column) -> Column:
    """` [p.1, p.5]`, or '' without pages."""
    marks = F.transform(pages, lambda p: F.concat(F.lit("p."), p.cast("string")))
    return F.when(F.size(pages) > 0, F.concat(F.lit(" ["), F.array_join(marks, ", "), F.lit("]"))).otherwise("")


def is_zero_priced_row(price: Column, item: Column, cleaned: Column) -> Column:
    raw = F.coalesce(price, F.lit(""))
    blob = F.lower(F.concat(raw, F.lit(" "), F.coalesce(item, F.lit(""))))
    digits = F.lower(_drop(strip(raw), "$, "))
    return (
        contains_any(blob, fixed.ZERO_ROW_WORDS)
        | digits.isin("0", "0.0", "0.00", "0.000", "-")
        | F.coalesce((F.abs(cleaned) < 0.005) & ~F.lower(strip(raw)).isin("", "nan", "none"), F.lit(False))
    )


def is_per_unit(frequency: Column, item: Column) -> Column:
    return F.rlike(F.concat_ws(" ", F.coalesce(frequency, F.lit("")), F.coalesce(item, F.lit(""))), F.lit(fixed.PER_UNIT))


def base_fee(item: Column) -> Column:
    """Item text without its trailing tier parenthesis or range."""
    s = strip(F.regexp_replace(strip(F.coalesce(item, F.lit(""))), fixed.TIER_PARENTHESIS, ""))
    s = strip(F.regexp_replace(s, fixed.TIER_TRAILING_RANGE, ""))
    return F.regexp_replace(F.lower(s), r"\s+", " ")


def infer_frequency(frequency: Column, item: Column, words=fixed.FREQUENCY_WORDS) -> Column:
    """Blank frequency filled from the item text; otherwise unchanged."""
    text = F.lower(F.coalesce(item, F.lit("")))
    guess = reduce(
        lambda acc, pair: F.when(contains_any(text, pair[1]), F.lit(pair[0])).otherwise(acc),
        reversed(words),
        frequency,
    )
    return F.when(strip(F.coalesce(frequency, F.lit(""))) != "", frequency).otherwise(guess)


def canon_frequency(text: Column) -> Column:
    """Monthly, Annual, One-Time or null; recurring wording wins over one-time wording."""
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    return (
        F.when(contains_any(t, fixed.MONTHLY_WORDS), "Monthly")
        .when(contains_any(t, fixed.ANNUAL_WORDS), "Annual")
        .when(contains_any(t, fixed.ONE_TIME_WORDS), "One-Time")
    )


def infer_cadence(first: Column, last: Column, invoices: Column, months: Column) -> Column:
    """Cadence of a code from the spacing of its invoices."""
    span = F.greatest(F.datediff(last, first), F.lit(0))
    ratio = months / F.greatest(span / 30.44, F.lit(1.0))
    gap = span / F.greatest(invoices - 1, F.lit(1))
    return (
        F.when(first.isNull() & last.isNull() & invoices.isNull(), "Unknown")
        .when(first.isNull() | last.isNull() | (F.coalesce(invoices, F.lit(0)) <= 1) | (span < 45), "One-Time")
        .when((ratio >= 0.6) | (gap <= 45), "Monthly")
        .when(gap >= 300, "Annual")
        .otherwise("Unknown")
    )


def cadence_agree(frequency: Column, cadence: Column) -> Column:
    """1 equal, 0.6 one step apart, 0.3 two steps, 0.5 when either side is unknown."""

    def step(c):
        return F.when(c == "One-Time", 0).when(c == "Monthly", 1).when(c == "Annual", 2)

    apart = F.abs(step(frequency) - step(cadence))
    return (
        F.when(frequency.isNull() | cadence.isNull() | cadence.isin("Unknown", ""), 0.5)
        .when(frequency == cadence, 1.0)
        .when(apart == 1, 0.6)
        .when(apart == 2, 0.3)
        .otherwise(0.0)
    )


def frequency_signal(frequency: Column, item: Column, cadence: Column, w_column=0.70, w_text=0.30) -> Column:
    col, hint = canon_frequency(frequency), canon_frequency(item)
    return (
        F.when(col.isNotNull() & hint.isNotNull(),
               w_column * cadence_agree(col, cadence) + w_text * cadence_agree(hint, cadence))
        .when(col.isNotNull(), cadence_agree(col, cadence))
        .when(hint.isNotNull(), cadence_agree(hint, cadence))
        .otherwise(0.5)
    )


def price_band(price: Column, median: Column, low: Column, high: Column, buffer: float = 0.25) -> Column:
    """1 near the median, 0.9 in range, 0.7 in the buffered range, then decaying."""
    scale = F.greatest(F.abs(median), F.lit(1.0))
    near = F.coalesce(F.abs(price - median) <= 0.02 * scale, F.lit(False))
    close = F.coalesce(F.abs(price - median) <= buffer * scale, F.lit(False))
    in_range = F.coalesce((price >= low) & (price <= high), F.lit(False))
    in_buffer = F.coalesce((price >= low * (1 - buffer)) & (price <= high * (1 + buffer)), F.lit(False))
    band = F.greatest(high - low, F.abs(F.coalesce(median, F.lit(0.0))), F.lit(1.0))
    distance = F.when(price < low, low - price).otherwise(price - high)
    return (
        F.when(near, 1.0)
        .when(in_range, 0.9)
        .when(in_buffer, 0.7)
        .when(close, 0.7)
        .when(low.isNull() | high.isNull(), 0.5)
        .otherwise(F.greatest(F.lit(0.0), 0.7 * (1.0 - distance / (3.0 * band))))
    )


def price_signal(price, has_stats, is_zero, per_unit, is_exact, stats: dict[str, Column]) -> Column:
    """Price score of one candidate code; `stats` has median/min/max of abs net and of unit price."""
    p = F.abs(F.coalesce(price.cast("double"), F.lit(0.0)))
    no_unit = stats["median_unit"].isNull() & stats["min_unit"].isNull() & stats["max_unit"].isNull()
    by_unit = F.when(no_unit, 0.5).otherwise(
        price_band(p, stats["median_unit"], stats["min_unit"], stats["max_unit"])
    )
    by_net = price_band(p, stats["median_abs_net"], stats["min_abs_net"], stats["max_abs_net"])
    free_before = F.coalesce(F.abs(stats["min_abs_net"]) < 0.5, F.lit(False))
    return (
        F.when(is_exact, 1.0)
        .when(is_zero & has_stats & free_before, 0.85)
        .when(is_zero | ~has_stats | (p <= 0), 0.5)
        .when(per_unit, by_unit)
        .otherwise(by_net)
    )
