"""Word lists, labels, patterns and weights the results depend on.

Everything here is data, not logic. Operators take these as defaults, so a caller can
pass its own.
"""

# ---- company names: abbreviation -> spelled out (applied in this order), filler words
NAME_ABBREVIATIONS = (
    ("FCU", "FEDERAL CREDIT UNION"),
    ("CU", "CREDIT UNION"),
    ("F C U", "FEDERAL CREDIT UNION"),
    ("NATL", "NATIONAL"),
    ("ASSN", "ASSOCIATION"),
    ("CORP", "CORPORATION"),
    ("CO", "COMPANY"),
    ("INTL", "INTERNATIONAL"),
    ("SVGS", "SAVINGS"),
    ("SVCS", "SERVICES"),
    ("BK", "BANK"),
)
NAME_FILLER = ("INC", "LLC", "LTD", "THE", "A", "OF", "AND", "NA")
NAME_ACRONYMS = (
    ("EFCU", "Employees Federal Credit Union"),
    ("FCU", "Federal Credit Union"),
    ("CU", "Credit Union"),
)

# ---- roster names: words that do not tell clients apart
ROSTER_GENERIC = (
    "credit", "union", "cu", "ltd", "limited", "inc", "incorporated", "the", "of", "and", "a", "an",
    "co", "company", "corp", "corporation", "fcu", "federal", "financial", "services", "service",
)

# ---- contract parties
PARTY_SUFFIXES = (
    "solutions", "incorporated", "incorporation", "inc", "llc", "ltd", "limited", "corp", "corporation",
    "company", "co", r"n\.a\.", "na", r"l\.l\.c\.", r"p\.c\.", "pllc", "plc", "gmbh", r"s\.a\.", r"s\.r\.l\.",
    "holdings", "group", "services",
)
PARTY_GENERIC = (
    "bank", "banking", "banks", "savings", "saving", "loan", "loans", "association", "associations", "assn",
    "federal", "national", "trust", "credit", "union", "co", "company", "companies", "financial",
    "the", "and", "of", "by", "with", "for", "an", "a", "n", "na", "fsb", "sb",
)

# ---- document codes
HIGH_VALUE_POSITIONS = (
    "handwritten_margin", "handwritten_inline", "printed_stamp", "printed_label_box", "printed_body",
)
LOW_VALUE_POSITIONS = ("printed_header", "printed_footer", "unknown")
CUSTOMER_LABEL = (
    r"(?i)\b(?:customer|account|client|subscriber|member|cust|acct|institution)(?:\s*(?:no\.?|number|num|id)\b|\s*#)"
)
REVISION_STAMP = r"(?i)^\s*(?:form\s+)?rev(?:ision)?\.?\s+\d{1,4}[-./\s]\d{1,4}(?:[-./\s]\d{1,4})?\b"
SIGNING_ENVELOPE = r"(?i)^\s*(?:docusigned\s+by|envelope\s+id)\s*[:.]?"
MARKETING_CODE = r"(?i)^\s*MKT\d+\s*[-/]\s*\d"
GUID_LIKE = r"[0-9a-f]{6,}-[0-9a-f]{3,}-[0-9a-f]{3,}-[0-9a-f]{3,}"

# ---- questions
INVOICE_TRIGGERS = (
    "invoice", "invoiced", "invoicing", "bill", "billed", "billing", "billable", r"\bsap\b",
    "net amount", "tax amount", "profit center", "sales office", "sales group", r"bill[\s\-]?to",
    "general ledger", r"\bg/?l\b", "charged", "charge amount", "material code", "material text",
)
CONTRACT_ID = r"(?i)\b(CTR[-_ ]?\d{2,6}|MSA[-_ ]?\d{2,6}|MA[-_ ]?\d{2,6}|SOW[-_ ]?\d{2,6}|FD\d{3,4})\b"
SINCE_INCEPTION = (
    r"(?i)\b(since\s+inception|all[\s-]?time|lifetime|to\s+date|ever\s+billed|since\s+the\s+(?:start|beginning))\b"
)
QUESTION_DATE = r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})\b"
SINCE_YEAR = r"(?i)\bsince\s+(\d{4})\b"
INVOICE_NUMBER = (
    r"(?i)\b(?:invoice|invoices|inv|doc|document|bill|billed|billing|receipt|#)"
    r"\s*(?:number|num|no|#)?\s*#?\s*(\d{6,12})\b"
)
CODE_TOKEN = r"\b[A-Za-z0-9]{4,}\b"

# ---- prices
ZERO_LABELS = ("no charge", "waived", "n/a", "none", "free")
KEPT_LABELS = ("included", "waived", "no charge", "n/a", "free", "complimentary", "tbd")
OVER_THRESHOLD = r"(?i)^over\s*\$"
MAGNITUDE = r"^\$?\d+(\.\d+)?\s*[MBmb]$"
ZERO_ROW_WORDS = (
    "included", "incl.", "incl ", "waiv", "prev paid", "prevpaid", "previously paid", "pre-paid", "prepaid",
    "no charge", "no-charge", "n/c", "n / c", "bundled", "complimentary", "at no cost", "free of charge",
)
PER_UNIT = (
    r"(?i)\bper\s+(user|account|acct|item|transaction|txn|trans|check|cheque|card|"
    r"statement|stmt|member|customer|location|branch|device|seat|licen[cs]e|call|"
    r"minute|click|unit|record|document|page|enrollment|loan|certificate|"
    r"appliance|mailbox|box|hour|gigabyte|gb|api|request|lookup|inquiry|alert|"
    r"message|sms|email|notice|deposit|withdrawal|payment|file|report|"
    r"envelope|kilobyte|subscription|application|end user)s?\b"
)
TIER_WORDS = (
    "account", "accounts", "dda", "ddas", "share draft", "share drafts", "transaction", "transactions",
    "user", "users", "seat", "seats", "member", "members", "item", "items", "ach", "card", "cards",
    "deposit", "deposits", "loan", "loans", "statement", "statements", "asset", "assets", "tier", "tiers",
    "subscriber", "subscribers", "device", "devices", "branch", "branches", "core", "cores",
    "customer", "customers", "client", "clients", "call", "calls", "minute", "minutes", "month", "months",
    "page", "pages", "record", "records", "report", "reports", "license", "licenses",
)

# ---- frequency
FREQUENCY_WORDS = (
    ("One-Time", ("one time", "one-time", "onetime", "set up", "set-up", "setup", "implementation", "implement")),
    ("Monthly", ("monthly", "month")),
    ("Annual", ("annual", "annually", "yearly", "year")),
)
MONTHLY_WORDS = ("month", "/mo", "recurring")
ANNUAL_WORDS = ("annual", "annually", "yearly", "per year", "/year", "p.a", " pa ", "per annum")
ONE_TIME_WORDS = (
    "one time", "one-time", "onetime", "set up", "set-up", "setup", "implementation", "implement",
    "upfront", "initial", "one off", "one-off", " ot ", "install",
)

# ---- legal wording removed before matching
LEGAL_NOISE = (
    r"(?i)\b(pursuant to|as defined in|hereinafter|section|schedule|exhibit|agreement|contract|dated|effective|"
    r"the foregoing|referred to as|including but not limited to|subject to|in accordance with|attachment|"
    r"amendment|addendum)\b"
)
TIER_PARENTHESIS = r"\s*\([^)]*\)\s*$"
TIER_TRAILING_RANGE = r"[\-–—]\s*[\d,]+\s*[\-–—]\s*[\d,]+\s*$"

# ---- clause families: single words, phrases, tokens kept on each side
CLAUSE_FAMILIES = {
    "term_renewal": (
        ("term", "renewal", "renew", "expiration", "expire", "expires"),
        ("auto-renew", "auto renew", "initial term", "renewal term", "term of this agreement", "shall expire"),
        70,
    ),
    "termination": (
        ("termination", "terminate", "terminated", "breach", "default"),
        ("termination for cause", "termination for convenience", "early termination", "early termination fee",
         "notice of termination", "right to terminate", "may terminate", "shall survive"),
        80,
    ),
    "sla": (
        ("uptime", "availability", "downtime", "outage"),
        ("service level", "service-level", "service level agreement", "service credit", "service credits",
         "response time", "resolution time", "incident", "severity 1", "severity level"),
        80,
    ),
    "volume_tiers": (
        ("minimum", "tier", "threshold", "overage"),
        ("volume tier", "tiered pricing", "minimum commitment", "minimum monthly", "minimum annual", "true-up",
         "true up", "in excess of", "per account", "per transaction", "per item"),
        80,
    ),
}
CLAUSE_FIELDS = {
    "term_renewal": ("initial_term", "renewal_period", "auto_renew", "notice_to_non_renew", "expiration_or_end_date"),
    "termination": ("termination_for_cause", "termination_for_convenience", "early_termination_fee",
                    "notice_period", "survival_clauses"),
    "sla": ("uptime_commitment", "service_credit_formula", "response_time", "resolution_time", "covered_services"),
    "volume_tiers": ("minimum_commitment", "volume_tiers", "tier_basis", "true_up_cadence", "overage_charges"),
}

# ---- documents
SUPPORTED_EXTENSIONS = ("pdf", "docx", "tif", "tiff", "txt", "msg")
CLAUSE_NAME_WORDS = ("master", "amendment", "services")
MASTER_WORDS = ("master agreement", "master-agreement", "master_agreement", "masteragreement", "msa", "master")
NOT_MASTER_WORDS = (
    "amendment", "addendum", "sow", "statement of work", "statement-of-work", "order form", "order-form",
    "order_form", "schedule",
)
MSA_NAME_WORDS = (
    "msa", "master agreement", "master-agreement", "master service", "master services", "master-services-agreement",
)
AMENDMENT_NAME_WORDS = ("amendment", "addendum", "amend")
RENEWAL_WORDS = ("renewal amendment", "renewal and amendment", "renewal & amendment")
SIGNATURE_WORDS = (
    "in witness whereof", "intending to be legally bound", "the parties have executed", "signed by:",
    "authorized signatory", "authorised signatory",
)
SIGNATURE_LINES = (
    r"(?m)^\s*by\s*:", r"(?m)^\s*name\s*:", r"(?m)^\s*title\s*:", r"(?m)^\s*signature\s*:", r"(?m)^\s*date\s*:",
)
LICENSE_TITLES = ("license and service agreement", "software license agreement", "master license agreement")

# ---- products and modules
MODULE_PARENTS = ("services exhibit", "software exhibit")
MODULE_LEVEL = "schedule"
NOT_MODULES = (
    "fees", "pricing", "general", "term", "terms", "hours of operation", "performance", "payment terms",
    "additional terms", "additional terms and conditions", "deconversion", "deconversion fees", "rescheduling fees",
    "termination fees", "termination", "delay of conversion", "conversion", "confidentiality", "defined terms",
    "definitions", "description of services", "service description", "services description attachment", "materials",
    "background", "recitals", "miscellaneous", "services", "software and license fees", "license fee payment schedule",
    "location", "computer system", "maintenance fees", "maintenance term", "maintenance term: initial term",
    "operations and support", "technical support", "client responsibilities",
)

# ---- load rows
LEGAL_CLAUSES = (
    r"late\s+payment\s+commitment", r"service\s+level\s+credits?", r"sla\s+credits?", "indemnif",
    r"limitation\s+of\s+liability", r"liability\s+cap", r"aggregate\s+liability",
)
# the vendor's own promises; {vendor} is its name
VENDOR_CLAUSES = (
    r"{vendor}\s+will\s+bear", r"{vendor}\s+will\s+credit", r"{vendor}\s+agrees\s+to\s+reimburse",
    r"{vendor}['’]?s\s+(?:responsibility|liability)",
)
PRICE_STATUSES = (
    "included", "bundled", "bundled fee", "tbd", "prev paid", "previously paid", "waived", "waived fee", "n/a", "na",
    "no charge", "nocharge", "free", "complimentary", "pass through", "pass-through",
)
PASS_THROUGH_WORDS = ("postage", "travel", "pass through", "pass-through", "third party", "third-party")

# ---- escalation
ESCALATION_DATE = r"\b(\d{1,2}[_/]\d{1,2}[_/]\d{4}|\d{1,2}\s+[A-Za-z]+\s+\d{4}|[A-Za-z]+\s+\d{1,2},\s*\d{4})\b"
ESCALATION_PERCENT = r"(?i)(\d+(?:\.\d+)?\s*(?:%|percent|percentage|bps|basis points))"
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
    "December",
)

# ---- contract types: spelling -> canonical type
TYPE_NAMES = (
    ("MSA", ("msa", "master agreement", "master service agreement", "master services agreement",
             "relationship agreement", "network membership agreement",
             "membership agreement", "amended and restated", "amended and restated agreement")),
    ("Amendment", ("amendment", "addendum", "first amendment", "second amendment", "third amendment",
                   "fourth amendment", "fifth amendment", "sixth amendment", "seventh amendment", "eighth amendment",
                   "ninth amendment", "tenth amendment", "amendment and restatement", "rider", "consent", "waiver",
                   "extension", "renewal", "change order")),
    ("Sub-Amendment", ("sub-amendment", "sub amendment")),
    ("SOW", ("sow", "statement of work", "consulting services exhibit")),
    ("Order Form", ("order form",)),
    ("Work Order", ("work order",)),
    ("Purchase Order", ("purchase order", "po")),
    ("Subsequent Order", ("subsequent order",)),
    ("Services Agreement", ("services agreement",)),
    ("Software Agreement", ("software agreement",)),
    ("Hardware Agreement", ("hardware agreement",)),
    ("Maintenance Agreement", ("maintenance agreement",)),
    ("Marketing Agreement", ("marketing agreement",)),
    ("Referral Agreement", ("referral agreement",)),
    ("Purchase Agreement", ("purchase agreement",)),
    ("Network Agreement", ("network agreement", "network agreements")),
    ("Internet Banking Agreement", ("internet banking agreement",)),
    ("Access Agreement", ("access agreement",)),
    ("Escrow Agreement", ("escrow agreement",)),
    ("Subscription Agreement", ("subscription agreement",)),
    ("Termination Notice", ("termination notice",)),
    ("Termination Agreement", ("termination agreement", "deconversion and termination agreement",
                               "deconversion agreement")),
    ("Schedule", ("schedule", "exhibit")),
    ("Appendix", ("appendix",)),
    ("Attachment", ("attachment",)),
    ("Miscellaneous", ("standalone", "stand-alone", "miscellaneous", "letter agreement", "side letter")),
    ("License Agreement", ("license agreement", "software license agreement")),
)
# filename wording -> type, first hit wins
FILENAME_TYPES = (
    (r"\bsub[-\s]?amendment\b", "Sub-Amendment"),
    (r"\bmaster\s+services?\s+agreement\b", "MSA"),
    (r"\bmaster\s+agreement\b", "MSA"),
    (r"\brelationship\s+agreement\b", "MSA"),
    (r"\bnetwork\s+membership\s+agreement\b", "MSA"),
    (r"\bmembership\s+agreement\b", "MSA"),
    (r"\bamended\s+and\s+restated\b", "MSA"),
    (r"\btermination\s+notice\b", "Termination Notice"),
    (r"\b(?:deconversion\s+and\s+)?termination\s+agreement\b", "Termination Agreement"),
    (r"\bdeconversion\s+agreement\b", "Termination Agreement"),
    (r"\bamendment\b", "Amendment"),
    (r"\baddendum\b", "Amendment"),
    (r"\brider\b", "Amendment"),
    (r"\bwaiver\b", "Amendment"),
    (r"\bconsent\b", "Amendment"),
    (r"\bextension\b", "Amendment"),
    (r"\brenewal\b", "Amendment"),
    (r"\bchange\s+order\b", "Amendment"),
    (r"\bpurchase\s+order\b", "Purchase Order"),
    (r"\bsubsequent\s+order\b", "Subsequent Order"),
    (r"\bstatement\s+of\s+work\b", "SOW"),
    (r"\border\s+form\b", "Order Form"),
    (r"\bwork\s+order\b", "Work Order"),
    (r"\bconsulting\s+services\s+exhibit\b", "SOW"),
    (r"\bservices\s+agreement\b", "Services Agreement"),
    (r"\bsoftware\s+agreement\b", "Software Agreement"),
    (r"\bsoftware\s+license\s+agreement\b", "License Agreement"),
    (r"\blicense\s+agreement\b", "License Agreement"),
    (r"\bnetwork\s+agreements?\b", "Network Agreement"),
    (r"\bhardware\s+agreement\b", "Hardware Agreement"),
    (r"\bmaintenance\s+agreement\b", "Maintenance Agreement"),
    (r"\bmarketing\s+agreement\b", "Marketing Agreement"),
    (r"\breferral\s+agreement\b", "Referral Agreement"),
    (r"\bpurchase\s+agreement\b", "Purchase Agreement"),
    (r"\binternet\s+banking\s+agreement\b", "Internet Banking Agreement"),
    (r"\baccess\s+agreement\b", "Access Agreement"),
    (r"\bescrow\s+agreement\b", "Escrow Agreement"),
    (r"\bsubscription\s+agreement\b", "Subscription Agreement"),
    (r"\bappendix\b", "Appendix"),
    (r"\battachment\b", "Attachment"),
    (r"\bexhibit\b", "Schedule"),
    (r"\bschedule\b", "Schedule"),
    (r"\bletter\s+agreement\b", "Miscellaneous"),
    (r"\bside\s+letter\b", "Miscellaneous"),
)
GENERIC_TYPES = ("Standalone", "Miscellaneous", "Unknown")
SPECIFIC_ROOT_TYPES = (
    "Services Agreement", "Software Agreement", "License Agreement", "Hardware Agreement", "Maintenance Agreement",
    "Marketing Agreement", "Referral Agreement", "Purchase Agreement", "Network Agreement", "Membership Agreement",
    "MSA", "Internet Banking Agreement", "Access Agreement", "Escrow Agreement", "Subscription Agreement",
)
ROOT_TYPES = (*SPECIFIC_ROOT_TYPES, "Miscellaneous")
CHILD_TYPES = (
    "Amendment", "Sub-Amendment", "Appendix", "Attachment", "SOW", "Schedule", "Purchase Order", "Order Form",
    "Work Order", "Subsequent Order", "Termination Notice", "Termination Agreement",
)
# preference among candidate parents; anything else 99
PARENT_RANKS = (
    (0, SPECIFIC_ROOT_TYPES),
    (1, ("Amendment", "Termination Notice", "Termination Agreement")),
    (2, ("Sub-Amendment",)),
    (3, ("SOW",)),
    (4, ("Schedule", "Appendix", "Attachment")),
    (5, ("Miscellaneous",)),
    (6, ("Purchase Order", "Order Form", "Work Order", "Subsequent Order")),
)
# rank in the type hierarchy, used by the nearest-date rule; anything else 99
TYPE_RANKS = (
    (0, ("MSA",)),
    (1, ("Amendment", "Termination Notice", "Termination Agreement")),
    (2, ("Sub-Amendment",)),
    (3, ("SOW", "Schedule", "Appendix", "Attachment", "Miscellaneous", "Purchase Order", "Order Form", "Work Order",
         "Subsequent Order", "Services Agreement", "Software Agreement", "License Agreement", "Network Agreement",
         "Hardware Agreement", "Maintenance Agreement", "Marketing Agreement", "Referral Agreement",
         "Purchase Agreement", "Internet Banking Agreement", "Access Agreement", "Escrow Agreement",
         "Subscription Agreement")),
)
# filename types that make a disagreeing extraction worth repeating
RESCUE_TYPES = (
    "MSA", "Services Agreement", "Software Agreement", "License Agreement", "Hardware Agreement",
    "Maintenance Agreement", "Marketing Agreement", "Referral Agreement", "Purchase Agreement", "Network Agreement",
    "Membership Agreement",
)
GENERIC_PARENT_PHRASES = (
    (r"\bmaster\s+services?\s+agreement\b", ("MSA",)),
    (r"\bmaster\s+agreement\b", ("MSA",)),
    (r"\b(?:the\s+)?msa\b", ("MSA",)),
    (r"\blicense\s+and\s+services?\s+agreement\b", ("License Agreement", "Services Agreement")),
    (r"\blicense\s+agreement\b", ("License Agreement",)),
    (r"\bdata\s+processing\s+services?\s+agreement\b", ("Services Agreement",)),
    (r"\bsoftware\s+agreement\b", ("Software Agreement",)),
    (r"\bhardware\s+agreement\b", ("Hardware Agreement",)),
)
AGREEMENT_NUMBER = (
    r"(?i)\b(?:agreement|contract|dpsa|sow|po)\s*(?:no\.?|number|num|#)\s*[:.]?\s*(\d{3,})\b|#\s*(\d{3,})\b"
)
# method -> base confidence
METHOD_SCORES = (
    ("root", 95), ("miscellaneous", 95), ("reference", 90), ("duplicate", 90), ("doc_code", 60), ("products", 45),
    ("chain_root", 40), ("single_msa_fallback", 35), ("date", 30), ("orphan", 0),
)
EXTRACTION_SCORES = (("high", 85), ("medium-high", 72), ("medium", 55), ("low", 25))
HIGH_SCORE, MEDIUM_SCORE = 70, 40
PRODUCT_SUFFIXES = (
    "services", "service", "schedule", "schedules", "exhibit", "exhibits", "module", "modules", "addendum", "addenda",
)
