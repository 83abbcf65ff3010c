"""Column functions against worked examples."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import contracts as fc
from ledgerloom.functions import documents as doc
from ledgerloom.functions import fuzzy, money
from ledgerloom.functions.names import name_variants, norm_company
from ledgerloom.functions.questions import is_invoice_question
from ledgerloom.functions.unicode import nfkc


def test_zero_price(col):
    prices = ["$1,234.56", "(1,234.56)", "12M", "Over $100M", "Waived", "N/A", "0", "$0.00", "TBD", None, "Included"]
    assert col(money.is_zero_price, prices) == [False, False, True, True, True, True, True, True, False, False, False]


def test_clean_price(col):
    prices = ["$1,234.56", "(1,234.56)", "12M", "Over $100M", "5%", "No Charge", "about 7 dollars", None, "TBD"]
    assert col(money.clean_price, prices) == ["$1,234.56", "-$1,234.56", "", "", "$5.00", "", "$7.00", "", ""]
    kept = ["Included", "5%", "12M", "TBD", "1234.5", "odd"]
    assert col(money.clean_price_keep_labels, kept) == ["Included", "5%", "12M", "TBD", "$1,234.50", "odd"]


def test_safe_amount(col):
    values = ["$1,234.56", "(1,234.56)", "12M", "500K", "", None, "nan", "x", "-3"]
    assert [float(x) for x in col(money.safe_amount, values)] == [1234.56, -1234.56, 0, 0, 0, 0, 0, 0, -3]


def test_page_cells(col):
    assert col(money.format_page, ["5", "5.0", "nan", None, "0"]) == ["5", "5", "", "", ""]


def test_tier_range(col):
    texts = ["Up to 500 accounts", "1,000 to 2,500 transactions", "range 500-1000 users", "over 10 items", "up to 500 things", "over 99"]
    assert col(money.tier_range, texts) == ["Up to 500 account", "1,000 to 2,500", "500-1000", "over 10", "", ""]


def test_canonical_frequency(col):
    texts = ["Per Month", "per member per month", "One Time", "setup then monthly", "Annual", "per annum", "each", None]
    assert col(money.canon_frequency, texts) == ["Monthly", "Monthly", "One-Time", "Monthly", "Annual", "Annual", None, None]


def test_company_names(col):
    a, b = col(norm_company, ["Blue Cross Texas FCU", "BLUE CROSS TEXAS FEDERAL CREDIT UNION"])
    assert a == b
    a, b = col(norm_company, ["FIRST CHOICE CREDIT UNION", "FIRSTENERGY CHOICE FEDERAL CU"])
    assert a != b
    assert col(name_variants, ["First  Choice FCU"]) == [["First Choice FCU", "First Choice Federal Credit Union"]]


def test_invoice_question(col):
    texts = ["what was billed last month", "show the SAP lines", "who signed it", "a billion stars", None]
    assert col(is_invoice_question, texts) == [True, True, False, True, False]


def test_code_noise(col):
    values = ["Contract 2035", "Customer Number 635", "REV 5-13-04", "Client Name/Institution #: X / 166", "Customer Numbering"]
    assert col(fc.is_customer_label, values) == [False, True, False, True, False]
    assert col(fc.is_template_mark, ["REV 5-13-04", "Rev 10/03", "Form Revision 11-05-13", "MKT301/022009", "Envelope ID: a", "2035"]) == [True] * 5 + [False]
    assert col(fc.code_numbers, ["Contract 2035", "0000000", "ID: 4b90ac5c-2799-4de2-a850-2391537c78c1", "06-19-2013"]) == [["2035"], [], [], ["2013"]]


def test_cited_dates_and_numbers(col):
    dates = col(fc.cited_dates, ["dated July 25 2007", "february 4, 2009", "of 2/30/2001 and 2/3/2001", "on 2012-07-01", "Agreement_7-1-2012"])
    assert [[str(x) for x in d] for d in dates] == [["2007-07-25"], ["2009-02-04"], ["2001-02-03"], ["2012-07-01"], []]
    assert col(fc.cited_numbers, ["Agreement #2035", "DPSA No. 2091", "see #12 and #777"]) == [["2035"], ["2091"], ["777"]]


def test_types(col):
    assert col(fc.normal_type, ["Master Agreement", "Standalone", "po", "", "Odd"]) == ["MSA", "Miscellaneous", "Purchase Order", "Unknown", "Odd"]
    names = ["BANK_Addendum_09-04-2012.pdf", "X_Software License Agreement_1.pdf", "plain.pdf"]
    assert col(fc.filename_type, names) == ["Amendment", "License Agreement", None]


def test_half_even_confidence(spark):
    rows = spark.createDataFrame([("reference", 85), ("reference", 55), ("doc_code", 25), ("orphan", 99)], "m string, x int")
    out = [r[0] for r in rows.select(fc.confidence_score(F.col("m"), F.col("x"))).collect()]
    assert out == [88, 72, 42, 0]  # 87.5 and 72.5 round to even


def test_escalation(col):
    texts = ["raised 3% or CPI, whichever is greater", "limited to CPI", "up 2.5 percent", "CPI-U plus 4%", ""]
    assert col(doc.escalation_terms, texts) == ["> CPI-U or 3%", "Limited to CPI-U", "Max 2.5%", "< CPI-U or 4%", "CPI Language not Found"]
    assert col(doc.eligibility_month, ["on 3/15/24", "from July 1, 2024", "13/1/2024"]) == ["March", "July", ""]
    span = lambda c: doc.span_after(c, "annual adjustment", ("whichever is greater", "whichever is lesser"))
    text = "x. Annual Adjustment by CPI. or 3%, whichever is lesser. Next."
    assert col(span, [text, "annual adjustment only"]) == ["Annual Adjustment by CPI. or 3%, whichever is lesser.", None]


def test_nfkc_only_where_needed(col):
    words = ["plain", "ﬁne", "café", "été", "①②", "Ｆｕｌｌ", "straße"]
    assert col(nfkc, words) == [unicodedata.normalize("NFKC", w) for w in words]


@pytest.mark.parametrize(
    "a, b, kind, want",
    [
        ("abc", "abd", "ratio", 66.6667), ("fuzzy was a bear", "fuzzy fuzzy was a bear", "token_set", 100.0),
        ("a b", "c d", "token_set", 33.3333), ("yankees", "new york yankees", "partial", 100.0), ("", "x", "weighted", 0.0),
        ("this is a test", "this is a test!", "weighted", 96.5517),
    ],
)
def test_fuzzy(a, b, kind, want):
    assert fuzzy.SCORERS[kind](a, b) == pytest.approx(want, abs=1e-3)


def test_filename_type_tries_patterns_only_on_names_with_their_word(col):
    """Every pattern of the list still decides; the plan folds the name once."""
    import re

    from pyspark.sql import functions as F

    from ledgerloom.functions import contracts as fc
    from ledgerloom.functions import fixed

    assert fc._needed_word(r"\b(?:deconversion\s+and\s+)?termination\s+agreement\b") == "termination"
    assert fc._needed_word(r"\bservices?\b") == "service"
    names = ["A_Master_Service_Agreement.pdf", "DECONVERSION AGREEMENT", "sub-Amendment_2", "subamendment", "Wor\u212a order", "work.order", None, "",
             *[re.sub(r"\\[bs]\+?|\(\?:|\)\?|[?*]|\[[^\]]*\]", " ", p) for p, _ in fixed.FILENAME_TYPES]]
    want = [next((kind for p, kind in fixed.FILENAME_TYPES if re.search(f"(?ia){p}", re.sub("[_.]", " ", n or ""))), None) for n in names]
    assert col(fc.filename_type, names) == want
    assert str(fc.filename_type(F.col("v"))._jc.toString()).count("translate") <= 1
