"""Views that give the test tables the shapes of contract and billing data.

Each view is one SELECT that Spark and DuckDB both run, so an oracle starts from the
same rows. `@arr(` stands for the array constructor; where splitting text into rows is
spelled differently, a view has a second text for Spark.
Values are varied with `%`; no view drops rows of its base table.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

RAW = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class View:
    sql: str
    spark_sql: str | None = None

    @property
    def duck(self) -> str:
        return self.sql.replace("@arr(", "list_value(")

    @property
    def spark(self) -> str:
        return (self.spark_sql or self.sql).replace("@arr(", "array(")


VIEWS: dict[str, View] = {}

_SOURCE = re.compile(r"\b(FROM|JOIN)\s+([a-z_]+)")


class Tables:
    """The parquet tables of one folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tag = "t" + hashlib.md5(self.folder.encode()).hexdigest()[:8]
        self._made: set[str] = set()

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.table(self._view(name))

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(self._bind(text.replace("@arr(", "array(")))

    def _bind(self, text: str) -> str:
        def swap(m: re.Match) -> str:
            known = m.group(2) in VIEWS or m.group(2) in RAW
            return f"{m.group(1)} {self._view(m.group(2)) if known else m.group(2)}"

        return _SOURCE.sub(swap, text)

    def _view(self, name: str) -> str:
        alias = f"{self._tag}_{name}"
        if name not in self._made:
            if name in RAW:
                df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                df = self.spark.sql(self._bind(VIEWS[name].spark))
            df.createOrReplaceTempView(alias)
            self._made.add(name)
        return alias


_OPEN: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, folder: str) -> Tables:
    """Tables of a folder; its views are set up once per application."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _OPEN or _OPEN[key].spark is not spark:
        _OPEN[key] = Tables(spark, folder)
    return _OPEN[key]


def sources_of(sql: str) -> list[str]:
    """Views a statement reads, dependencies first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for _, name in _SOURCE.findall(text):
            if name in VIEWS and name not in out:
                visit(VIEWS[name].duck)
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


# ---------------------------------------------------------------- billing lines

_MATERIAL = "concat('BRD', lpad(replace(p_brand, 'Brand#', ''), 2, '0'), lpad(cast(p_size AS string), 2, '0'))"

_INVOICE = f"""cast(10000000 + o_orderkey AS string) AS document,
       cast(o_orderdate AS date) AS invoice_date,
       o_custkey, l_suppkey,
       {_MATERIAL} AS material,
       concat(p_name, ' ', p_type) AS material_text,
       p_type AS hier_name,
       l_returnflag AS item_category,
       l_linenumber AS line_no,
       cast(l_quantity AS decimal(18,2)) AS quantity,
       cast(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END
            * round(cast(l_extendedprice AS decimal(18,2)) * (1 - cast(l_discount AS decimal(18,2))), 2)
            AS decimal(18,2)) AS net,
       cast(l_tax AS decimal(18,2)) AS tax_rate,
       CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('https://invoices.example/', o_orderkey) END AS url"""

# order-level and line-level columns only: no dimension joins
VIEWS["invoice_core"] = View(f"""
SELECT {_INVOICE}
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey
""")

# Spark joins in the order of the text: orders meet customers before lines meet orders, so that lines are not dealt by
# customer, and lines meet parts before contracts, so that contract names are not dealt by part

# adds bill-to and sold-to
VIEWS["invoice_parties"] = View("""
SELECT i.*,
       cast(round(net * tax_rate, 2) AS decimal(18,2)) AS tax,
       cast(o_custkey AS string) AS billto,
       CASE o_custkey % 4
            WHEN 0 THEN concat(c_name, ' Federal Credit Union')
            WHEN 1 THEN concat(c_name, ' FCU')
            WHEN 2 THEN concat('The ', c_name, ' CU Branch')
            ELSE c_name END AS billto_name,
       cast(c_nationkey AS string) AS soldto,
       n_name AS soldto_name,
       c_mktsegment AS gl_category
FROM invoice_core i
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
""", f"""
SELECT i.* EXCEPT (c_name, c_nationkey, n_name, c_mktsegment),
       cast(round(net * tax_rate, 2) AS decimal(18,2)) AS tax,
       cast(o_custkey AS string) AS billto,
       CASE o_custkey % 4
            WHEN 0 THEN concat(c_name, ' Federal Credit Union')
            WHEN 1 THEN concat(c_name, ' FCU')
            WHEN 2 THEN concat('The ', c_name, ' CU Branch')
            ELSE c_name END AS billto_name,
       cast(c_nationkey AS string) AS soldto,
       n_name AS soldto_name,
       c_mktsegment AS gl_category
FROM (SELECT {_INVOICE}, c_name, c_nationkey, n_name, c_mktsegment
      FROM lineitem
      JOIN part ON l_partkey = p_partkey
      JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) o ON l_orderkey = o_orderkey) i
""")

# lines with the name of their contract client
VIEWS["client_lines"] = View("""
SELECT i.*, c_custkey, c_name AS client
FROM invoice_core i
JOIN customer ON o_custkey = c_custkey
""", f"""
SELECT {_INVOICE}, c_custkey, c_name AS client
FROM lineitem
JOIN part ON l_partkey = p_partkey
JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) o ON l_orderkey = o_orderkey
""")

# the party table behind the lines: one row per bill-to
VIEWS["parties"] = View("""
SELECT cast(c_custkey AS string) AS billto,
       CASE c_custkey % 4
            WHEN 0 THEN concat(c_name, ' Federal Credit Union')
            WHEN 1 THEN concat(c_name, ' FCU')
            WHEN 2 THEN concat('The ', c_name, ' CU Branch')
            ELSE c_name END AS billto_name,
       cast(c_nationkey AS string) AS soldto, n_name AS soldto_name
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")

VIEWS["invoice_lines"] = View("""
SELECT p.*, s_name AS profit_center
FROM invoice_parties p
JOIN supplier ON l_suppkey = s_suppkey
""")

# one row per customer, the way the contract folder spells its name
VIEWS["clients"] = View("""
SELECT cast(c_custkey AS string) AS client_id,
       CASE c_custkey % 4
            WHEN 0 THEN concat(c_name, ' FCU')
            WHEN 1 THEN concat(c_name, ' Federal  Credit Union')
            WHEN 2 THEN concat(lower(c_name), ' credit union')
            ELSE c_name END AS client
FROM customer
""")

VIEWS["countries"] = View("""
SELECT replace(n_name, '_', ' ') AS client FROM nation
""")

# ------------------------------------------------------------------- contracts

VIEWS["contract_base"] = View("""
SELECT o_orderkey, o_custkey, c_name AS client,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Master Agreement'
            WHEN '2-HIGH' THEN 'Amendment'
            WHEN '3-MEDIUM' THEN 'Software Agreement'
            WHEN '4-NOT SPECIFIED' THEN 'Statement of Work'
            ELSE 'Purchase Order' END AS contract_type,
       cast(o_orderdate AS date) AS effective_date,
       cast(o_orderdate AS date) + cast(o_orderkey % 5 AS int) AS signed_date,
       cast(floor(o_totalprice * 10) AS bigint) AS size,
       cast(5 + o_orderkey % 40 AS int) AS pages
FROM orders JOIN customer ON o_custkey = c_custkey
""")

VIEWS["contracts"] = View("""
SELECT b.*,
       concat(replace(client, '#', '-'), '_', replace(contract_type, ' ', '-'), '_',
              month(effective_date), '-', day(effective_date), '-', year(effective_date), '_', o_orderkey, '.pdf') AS filename
FROM contract_base b
""")

# codes the contracts name: some changed (mismatch), some unknown to billing (contract only)
_CODE_ROW = f"""SELECT c.client, c.filename AS source_contract, l_linenumber AS page,
       CASE WHEN p_size % 7 = 0 THEN concat('X', {_MATERIAL})
            WHEN p_size % 7 = 1 THEN concat('Z', {_MATERIAL})
            WHEN p_size % 7 = 2 THEN concat(' ', {_MATERIAL}, ' ')
            ELSE {_MATERIAL} END AS code,
       CASE WHEN p_size % 7 = 1 THEN concat('Unbilled ', p_name, ' ', l_linenumber)
            WHEN p_size % 7 = 3 THEN ''
            ELSE concat(p_name, ' & ', p_type) END AS description,
       concat(p_name, ' Fee') AS item,
       concat('$', cast(cast(l_extendedprice AS decimal(18,2)) AS string)) AS price
"""
VIEWS["contract_codes"] = View(f"""
{_CODE_ROW}FROM lineitem
JOIN contracts c ON l_orderkey = c.o_orderkey
JOIN part ON l_partkey = p_partkey
""", f"""
{_CODE_ROW}FROM lineitem
JOIN part ON l_partkey = p_partkey
JOIN contracts c ON l_orderkey = c.o_orderkey
""")

# ------------------------------------------------------------------- questions

VIEWS["questions"] = View("""
SELECT cast(o_orderkey AS string) AS question_id, o_custkey, o_orderkey,
       CASE o_custkey % 4
            WHEN 0 THEN concat(c_name, ' FCU')
            WHEN 1 THEN concat(c_name, ' Federal  Credit Union')
            WHEN 2 THEN concat(lower(c_name), ' credit union')
            ELSE c_name END AS client,
       CASE o_orderkey % 10
            WHEN 0 THEN concat('What was billed under CTR ', 100 + o_orderkey % 900, ' and msa_12 or CTR-', 100 + o_orderkey % 900, ' since ', 1990 + o_orderkey % 30, '?')
            WHEN 1 THEN concat('Show billing for FD306 between 1996-1-0', 1 + o_orderkey % 9, ' and 3/', 1 + o_orderkey % 31, '/1998')
            WHEN 2 THEN concat('invoice number ', 10000000 + o_orderkey, ' and doc # ', 10000000 + o_orderkey % 97, ', not $1,000,000')
            WHEN 3 THEN concat('Was BRD0', 1 + o_orderkey % 9, '1', o_orderkey % 10, ' or zbrd0', 1 + o_orderkey % 9, '22 ever billed?')
            WHEN 4 THEN concat('Total charges to date on FD', 100 + o_orderkey % 900, ' from 1997-02-30')
            WHEN 5 THEN concat('A billion reasons, SOW 7 and sow-7; receipt 99', 100000 + o_orderkey, ' inv ', 10000000 + o_orderkey)
            WHEN 6 THEN concat('Charged on 2/29/1996 and later? the profit center of xbrd', lpad(cast(1 + o_orderkey % 25 AS string), 2, '0'), '07 please')
            WHEN 7 THEN concat('Who signed the agreement ', o_orderkey, '?')
            WHEN 8 THEN concat('bill ', 10000000 + o_orderkey, ', bill ', 10000000 + o_orderkey, ' and billing num 1234567')
            ELSE concat('since inception: SAP lines of brd', lpad(cast(1 + o_orderkey % 25 AS string), 2, '0'), lpad(cast(1 + o_orderkey % 50 AS string), 2, '0'), ' from 2001/5/', 1 + o_orderkey % 28) END AS text
FROM orders JOIN customer ON o_custkey = c_custkey
""")

# ----------------------------------------------------------------- fee items

_FEE_ITEM = f"""SELECT c.client, c.filename AS source_contract,
       concat(l_orderkey, '-', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
              l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS item_id,
       concat(p_name, CASE l_partkey % 7 WHEN 0 THEN ' Monthly Fee' WHEN 1 THEN ' Setup Fee'
                           WHEN 2 THEN ' (1,000 to 2,500 accounts)' WHEN 3 THEN ' up to 500 accounts'
                           WHEN 4 THEN ' per transaction charge' WHEN 5 THEN concat(' ', p_type, ' - 5,001 - 7,500')
                           ELSE concat('  ', p_type, ' postage') END) AS item,
       CASE (l_partkey + l_linenumber) % 13
            WHEN 0 THEN concat('$', cast(cast(l_extendedprice AS decimal(18,2)) AS string))
            WHEN 1 THEN concat('($', cast(cast(l_extendedprice AS decimal(18,2)) AS string), ')')
            WHEN 2 THEN '12M' WHEN 3 THEN 'Over $100M' WHEN 4 THEN 'Included' WHEN 5 THEN 'Waived'
            WHEN 6 THEN 'N/A' WHEN 7 THEN '$0.00' WHEN 8 THEN '5%' WHEN 9 THEN ' TBD '
            WHEN 10 THEN NULL WHEN 11 THEN concat(' USD ', cast(cast(l_extendedprice AS decimal(18,2)) AS string))
            ELSE '1,234,567.891 per year' END AS price,
       CASE WHEN l_quantity > 25 THEN cast(cast(l_quantity AS int) AS string) ELSE '' END AS quantity,
       CASE l_partkey % 8 WHEN 0 THEN 'Per Month' WHEN 1 THEN 'One Time' WHEN 2 THEN 'Annual' WHEN 3 THEN ''
                          WHEN 4 THEN NULL WHEN 5 THEN 'per transaction / monthly' WHEN 6 THEN 'each' ELSE 'upfront' END AS frequency,
       CASE l_linenumber % 3 WHEN 1 THEN true WHEN 2 THEN false END AS checkbox,
       CASE p_size % 3 WHEN 0 THEN concat(p_type, ' Services') WHEN 1 THEN upper(p_type) ELSE p_type END AS section_header,
       l_linenumber AS page,
       CASE p_size % 5 WHEN 0 THEN concat('subject to a minimum fee of $1,', 100 + p_size, '.50 each month')
                       WHEN 1 THEN 'Late payment commitment applies' WHEN 2 THEN NULL ELSE 'none' END AS pricing_condition,
       CASE WHEN l_tax > 0.05 THEN 'Vendorco will credit the client' ELSE '' END AS explanation,
       {_MATERIAL} AS material, cast(l_extendedprice AS decimal(18,2)) AS amount, c.signed_date,
       p_name, p_type, l_partkey, l_returnflag
"""
VIEWS["fee_items"] = View(f"""
{_FEE_ITEM}FROM lineitem
JOIN contracts c ON l_orderkey = c.o_orderkey
JOIN part ON l_partkey = p_partkey
""", f"""
{_FEE_ITEM}FROM lineitem
JOIN part ON l_partkey = p_partkey
JOIN contracts c ON l_orderkey = c.o_orderkey
""")

VIEWS["dictionary"] = View(f"""
SELECT p_partkey AS position, {_MATERIAL} AS code, concat(p_name, ' ', p_type) AS description, p_type AS section,
       CASE p_size % 3 WHEN 0 THEN 'ZINL' WHEN 1 THEN 'ZINM' ELSE '' END AS item_category,
       CASE WHEN p_size % 2 = 0 THEN 'ZPRM' ELSE '' END AS condition_type,
       CASE WHEN p_size % 4 = 0 THEN 'No' ELSE 'Yes' END AS cpi_eligible
FROM part
""")

# every contract file and a renamed copy of it
VIEWS["files"] = View("""
SELECT client, filename, size, pages,
       CASE WHEN o_orderkey % 6 = 0 THEN 'This Renewal Amendment is made' ELSE 'This document' END AS head_text
FROM contracts JOIN orders USING (o_orderkey)
UNION ALL
SELECT client, CASE WHEN o_orderkey % 3 = 0 THEN concat('Copy ', filename) ELSE replace(filename, '.pdf', '_copy.pdf') END,
       size + 1, pages + 1, 'This document'
FROM contracts JOIN orders USING (o_orderkey)
""")

VIEWS["overview"] = View("""
SELECT client, filename, contract_type,
       CASE WHEN o_orderkey % 4 = 0 THEN 'MasterAgreement' ELSE 'Other' END AS document_type,
       CASE WHEN o_orderkey % 5 = 0 THEN concat('Software License Agreement ', o_orderkey) WHEN o_orderkey % 5 = 1 THEN NULL
            ELSE 'Master Services with license agreement' END AS agreement_type,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE effective_date END AS effective_date,
       cast(o_orderkey % 3 AS int) AS schedules, o_orderkey
FROM contracts
""")

VIEWS["hierarchy_source"] = View("""
SELECT client, filename, contract_type, effective_date, signed_date,
       CASE WHEN o_orderkey % 2 = 0 THEN 'other.pdf' ELSE '' END AS duplicate_of
FROM contracts
""")

VIEWS["module_rows"] = View("""
SELECT client, source_contract AS filename,
       CASE l_partkey % 4 WHEN 0 THEN 'Services Exhibit' WHEN 1 THEN ' software exhibit ' WHEN 2 THEN 'Services Exhibit' ELSE 'Appendix' END AS parent,
       CASE l_partkey % 5 WHEN 0 THEN 'Exhibit' ELSE 'Schedule' END AS level,
       CASE l_partkey % 6 WHEN 0 THEN '' ELSE concat(p_type, ' Schedule to ',
            CASE l_partkey % 4 WHEN 1 THEN ' software exhibit ' WHEN 3 THEN 'Appendix' ELSE 'Services Exhibit' END) END AS product,
       CASE page WHEN 1 THEN 'Pricing' WHEN 2 THEN concat(p_type, ' schedule to services exhibit') WHEN 3 THEN 'nan' ELSE p_name END AS module
FROM fee_items
""")

VIEWS["manifest"] = View("""
SELECT DISTINCT client, source_contract AS filename,
       CASE WHEN l_partkey % 3 = 0 THEN ' software exhibit ' ELSE 'Services Exhibit' END AS parent, p_type AS schedule_title
FROM fee_items
""")

# ---------------------------------------------------------------------- pages

VIEWS["pages_text"] = View("""
SELECT source AS client, concat(doc_id, '.pdf') AS filename, doc_id,
       cast(unnest(range(1, len(lines) + 1)) AS int) AS page, unnest(lines) AS text
FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents) d
""", """
SELECT source AS client, concat(doc_id, '.pdf') AS filename, doc_id, page0 + 1 AS page, line AS text
FROM documents LATERAL VIEW posexplode(split(text, '\\n')) x AS page0, line
""")

# ------------------------------------------------------------------- hierarchy

# dates fall on two days a year, so ties and copies occur
VIEWS["contract_days"] = View("""
SELECT o_orderkey, o_custkey, client, contract_type,
       make_date(cast(year(effective_date) AS int), CASE o_orderkey % 2 WHEN 0 THEN 1 ELSE 7 END, 15) AS eff
FROM contract_base
""")

VIEWS["contract_meta"] = View("""
SELECT client, concat(client, '/', filename) AS key, filename, raw_type AS contract_type,
       CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN eff + 200 ELSE eff END AS effective_date,
       CASE o_orderkey % 6 WHEN 0 THEN NULL ELSE eff + cast(o_orderkey % 5 AS int) END AS signed_date,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL
            WHEN o_orderkey % 10 = 3 THEN @arr('Vendorco Solutions, Inc.', 'Atlas Bank, Inc.')
            ELSE @arr('Vendorco Solutions, LLC', concat(client, CASE o_orderkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Savings Bank' ELSE ' West' END)) END AS parties,
       CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS extraction_confidence,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE cast(40 + o_orderkey % 60 AS int) END AS extraction_score,
       CASE o_orderkey % 6 WHEN 1 THEN false WHEN 2 THEN true END AS is_active,
       o_orderkey, o_custkey
FROM (SELECT *,
             CASE o_orderkey % 11 WHEN 0 THEN 'Unknown' WHEN 1 THEN ' Standalone' WHEN 2 THEN 'Mystery Paper' ELSE contract_type END AS raw_type,
             concat(CASE WHEN o_orderkey % 10 = 3 THEN 'Atlas Bank' ELSE replace(client, '#', '-') END, '_', contract_type, '_',
                    month(eff), '-', day(eff), '-', year(eff), '_', o_orderkey, '.pdf') AS filename
      FROM contract_days) d
""")

VIEWS["cited_masters"] = View("""
SELECT o_orderkey, o_custkey, eff,
       max(CASE WHEN contract_type = 'Master Agreement' THEN eff END)
           OVER (PARTITION BY o_custkey ORDER BY eff, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
           + cast(o_orderkey % 10 AS int) AS cited
FROM contract_days
""")

VIEWS["citations"] = View("""
SELECT m.client, m.key, 0 AS position, 'parent_reference' AS source,
       CASE WHEN c.cited IS NULL THEN 'as amended by the Master Agreement'
            WHEN m.o_orderkey % 7 = 0 THEN 'under the Software Agreement between the parties'
            WHEN m.o_orderkey % 4 = 0 THEN concat('pursuant to Agreement #', 1000 + m.o_custkey * 3 + m.o_orderkey % 3)
            WHEN m.o_orderkey % 4 = 1 THEN concat('Master Agreement dated ', substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(3 * month(c.cited) - 2 AS int), 3), ' ', day(c.cited), ', ', year(c.cited))
            WHEN m.o_orderkey % 4 = 2 THEN concat('the agreement of ', month(c.cited), '/', day(c.cited), '/', year(c.cited), ' and its schedules')
            ELSE concat('signed ', cast(c.cited AS string)) END AS quote
FROM contract_meta m JOIN cited_masters c ON m.o_orderkey = c.o_orderkey
UNION ALL
SELECT m.client, m.key, 1, 'parent_reference', concat('AMENDMENT dated as of ', month(c.eff), '/', day(c.eff), '/', year(c.eff))
FROM contract_meta m JOIN cited_masters c ON m.o_orderkey = c.o_orderkey
UNION ALL
SELECT m.client, m.key, 2, 'supersedes_clause', CASE WHEN m.o_orderkey % 5 = 0 AND c.cited IS NOT NULL THEN concat('supersedes the paper of ', cast(c.cited AS string)) ELSE '' END
FROM contract_meta m JOIN cited_masters c ON m.o_orderkey = c.o_orderkey
""")

VIEWS["doc_codes"] = View("""
SELECT client, key, concat('Contract ', 1000 + o_custkey * 3 + o_orderkey % 3) AS value,
       CASE o_orderkey % 8 WHEN 0 THEN 'handwritten_margin' WHEN 1 THEN 'handwritten_inline' WHEN 2 THEN 'printed_stamp' WHEN 3 THEN 'printed_label_box'
            WHEN 4 THEN 'printed_body' WHEN 5 THEN 'printed_header' WHEN 6 THEN 'printed_footer' ELSE 'scribble' END AS position
FROM contract_meta
UNION ALL
SELECT client, key, 'Customer Number 635', 'printed_body' FROM contract_meta
UNION ALL
SELECT client, key, CASE o_orderkey % 4 WHEN 0 THEN 'REV 5-13-04' WHEN 1 THEN 'MKT301/022009' WHEN 2 THEN 'ID: 4b90ac5c-2799-4de2-a850-2391537c78c1' ELSE '0000000' END,
       CASE o_orderkey % 3 WHEN 0 THEN 'printed_body' ELSE 'printed_footer' END FROM contract_meta
UNION ALL
SELECT client, key, '290', CASE WHEN o_orderkey % 9 = 0 THEN 'handwritten_margin' ELSE 'printed_header' END FROM contract_meta
""", """
SELECT client, key, c.value, c.position FROM (
  SELECT client, key, explode(array(
    named_struct('value', concat('Contract ', 1000 + o_custkey * 3 + o_orderkey % 3), 'position',
         CASE o_orderkey % 8 WHEN 0 THEN 'handwritten_margin' WHEN 1 THEN 'handwritten_inline' WHEN 2 THEN 'printed_stamp' WHEN 3 THEN 'printed_label_box'
              WHEN 4 THEN 'printed_body' WHEN 5 THEN 'printed_header' WHEN 6 THEN 'printed_footer' ELSE 'scribble' END),
    named_struct('value', 'Customer Number 635', 'position', 'printed_body'),
    named_struct('value', CASE o_orderkey % 4 WHEN 0 THEN 'REV 5-13-04' WHEN 1 THEN 'MKT301/022009' WHEN 2 THEN 'ID: 4b90ac5c-2799-4de2-a850-2391537c78c1' ELSE '0000000' END,
         'position', CASE o_orderkey % 3 WHEN 0 THEN 'printed_body' ELSE 'printed_footer' END),
    named_struct('value', '290', 'position', CASE WHEN o_orderkey % 9 = 0 THEN 'handwritten_margin' ELSE 'printed_header' END))) AS c
  FROM contract_meta) m
""")

VIEWS["contract_products"] = View("""
SELECT DISTINCT m.client, m.key, p_name AS product
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN contract_meta m ON l_orderkey = m.o_orderkey
""")

# -------------------------------------------------------------------- matching

# every part name has one vector; descriptions and items built on it share it
VIEWS["name_vectors"] = View("""
SELECT p_name, embedding AS vector FROM (
  SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS n FROM (SELECT DISTINCT p_name FROM part) p) r
JOIN embeddings ON vec_id = n
""")

VIEWS["checked_items"] = View("""
SELECT client, item_id, item, source_contract, price, price AS price_text, concat(p_name, ' ', p_type) AS matched_description,
       section_header AS section, amount,
       CASE WHEN l_partkey % 4 = 0 THEN amount WHEN l_partkey % 4 = 1 THEN cast(0 AS decimal(18,2)) ELSE cast(floor(amount * 50) / 100 AS decimal(18,2)) END AS price_value,
       CASE WHEN quantity = '' THEN '1' ELSE quantity END AS quantity, frequency,
       CASE WHEN l_partkey % 5 = 0 THEN concat('X', material) WHEN l_partkey % 5 = 1 THEN '' ELSE material END AS incumbent,
       material, l_partkey, page
FROM fee_items
""")

VIEWS["raw_products"] = View("""
SELECT DISTINCT m.client, m.key,
       concat(CASE p_partkey % 4 WHEN 0 THEN upper(p_name) ELSE p_name END,
              CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' Services Schedule to the Exhibit' WHEN 2 THEN ' Service' WHEN 3 THEN ' / Module' ELSE 's' END) AS product
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN contract_meta m ON l_orderkey = m.o_orderkey
""")

VIEWS["product_terms"] = View("""
SELECT concat('terms_v', 1 + p_partkey % 3, '.csv') AS file, p_partkey AS position, concat(' ', p_name, ' ') AS term FROM part
""")

VIEWS["roster"] = View("""
SELECT n_name AS engagement, concat('Customer-', lpad(cast(n_nationkey AS string), 9, '0'), ' Bank') AS alias,
       concat('customer#', lpad(cast(n_nationkey AS string), 9, '0'), ' CREDIT UNION LTD') AS name
FROM nation
""")

# --------------------------------------------------------------- model replies

# three chunks per contract; some replies are fenced, wrapped in prose, or cut off
VIEWS["model_replies"] = View("""
SELECT client, key, chunk,
       CASE (o_orderkey + chunk) % 5
            WHEN 0 THEN concat('```json', chr(10), '{"items": ', objects, '}', chr(10), '```')
            WHEN 1 THEN concat('Here you are: {"items": ', objects, '} Done.')
            WHEN 2 THEN objects
            WHEN 3 THEN concat('{"items": [{"row_id": ', o_orderkey, ', "code": "C', chunk, '", "price": "$1"}, {"row_id": 7, "code": "cut')
            ELSE 'I cannot read this page.' END AS reply, o_orderkey
FROM (SELECT client, key, o_orderkey, chunk, concat('[{"row_id": ', o_orderkey, ', "code": "A', chunk, '", "price": "$', o_orderkey % 100, '"}, {"row_id": ', chunk, ', "code": "B", "price": null}]') AS objects
      FROM (SELECT client, key, o_orderkey, 0 AS chunk FROM contract_meta UNION ALL SELECT client, key, o_orderkey, 1 FROM contract_meta
            UNION ALL SELECT client, key, o_orderkey, 2 FROM contract_meta) c) o
""")

VIEWS["chunk_replies"] = View("""
SELECT client, key, chunk, o_orderkey,
       concat('{"contract_type": "', CASE chunk WHEN 0 THEN contract_type ELSE 'Later type' END, '", "effective_date": "200', chunk, '-01-01", ',
              '"parties": ["P', chunk, '"], "parent_references": ["ref ', chunk % 2, '", "", "own ', o_orderkey, '"], ',
              '"supersedes_text": ', CASE WHEN chunk = 0 THEN 'null' ELSE concat('"old paper ', chunk, '"') END, ', ',
              '"internal_doc_codes": [{"value": " 77', o_orderkey % 3, '", "position": "', CASE chunk WHEN 0 THEN 'unknown' WHEN 1 THEN 'printed_body' ELSE 'scribble' END, '"}, {"value": "X', chunk, '", "position": "printed_stamp"}, {"value": "", "position": "printed_body"}], ',
              '"section_structure": [{"header": "Fees", "product": ', CASE chunk WHEN 1 THEN '"Ledger"' ELSE '"n/a"' END, ', "subheaders": [{"text": "One", "product": null, "items": ["a', chunk % 2, '", "b"]}]}, {"header": "S', chunk, '", "product": null, "subheaders": []}], ',
              '"extraction_confidence": ', CASE (o_orderkey + chunk) % 4 WHEN 0 THEN '"high"' WHEN 1 THEN '"medium"' WHEN 2 THEN '"low"' ELSE 'null' END,
              ', "extraction_confidence_score": ', o_orderkey % 90 + chunk * 10, '}') AS reply
FROM (SELECT client, key, o_orderkey, contract_type, 0 AS chunk FROM contract_meta UNION ALL SELECT client, key, o_orderkey, contract_type, 1 FROM contract_meta
      UNION ALL SELECT client, key, o_orderkey, contract_type, 2 FROM contract_meta) c
""")

VIEWS["old_records"] = View("""
SELECT client, key, filename, contract_type, o_orderkey, o_orderkey % 2 AS n_references,
       CASE o_orderkey % 4 WHEN 0 THEN '["12345", " x "]' WHEN 1 THEN '[{"value": "12345", "position": "printed_body"}, "77", {"value": "9", "position": "nowhere"}]' WHEN 2 THEN '[]' END AS codes_json,
       o_orderkey % 3 AS n_nested, o_orderkey % 5 AS n_flat, o_orderkey % 10 = 0 AS failed, o_orderkey % 7 = 0 AS references_attempted,
       o_orderkey % 6 = 0 AS type_attempted, o_orderkey % 8 = 0 AS codes_attempted, o_orderkey % 9 = 0 AS sections_attempted
FROM contract_meta
""")

VIEWS["file_paths"] = View("""
SELECT concat('/contracts/', replace(client, '#', '-'), '/', CASE o_orderkey % 6 WHEN 0 THEN replace(filename, '.pdf', '.xlsx') WHEN 1 THEN replace(filename, '.pdf', '.TIF') ELSE filename END) AS path, size
FROM contracts
""")

VIEWS["dictionary_files"] = View("""
SELECT c_mktsegment AS core, concat('/in/', c_mktsegment, '/', CASE c_custkey % 7 WHEN 0 THEN 'Dictionary' ELSE 'prices' END, '_', c_custkey, '.csv') AS path, cast(floor(c_acctbal) AS bigint) AS size
FROM customer
""")

# ---------------------------------------------------------- messages and usage

VIEWS["messages"] = View("""
SELECT concat(conv_id, '-', turn) AS message_id,
       concat(c.text, CASE turn % 4
         WHEN 0 THEN concat(chr(10), 'see ', k.filename, ' p. 9')
         WHEN 1 THEN concat(chr(10), 'not ', k.filename, chr(10), '## Sources:', chr(10), replace(upper(k2.filename), '.PDF', ''), ' p.12, p. 7 and [INVOICE] ', 10000000 + k.o_orderkey, ' https://other.example/x1).')
         WHEN 2 THEN concat(chr(10), 'https://invoices.example/', k.o_orderkey, ' [invoice] see https://other.example/', turn, ', ')
         ELSE '' END) AS text
FROM conversations c JOIN contracts k ON k.o_orderkey = c.conv_id JOIN contracts k2 ON k2.o_orderkey = c.conv_id + 1
""")

VIEWS["usage"] = View("""
SELECT event_id AS run_id, cast(user_id AS string) AS client, event_type AS agent, ts, value AS runtime_s,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 100 END AS input_tokens, 2 * (event_id % 50) AS output_tokens,
       CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 = 1 THEN NULL ELSE event_id % 300 END AS total_tokens,
       CASE event_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE '' END AS requested_model,
       CASE event_id % 4 WHEN 0 THEN 'large-2' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE 'small-2' END AS actual_model,
       CASE event_type WHEN 'click' THEN 'complete' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'queued' WHEN 'error' THEN 'error' ELSE 'paused' END AS state
FROM events
""")
