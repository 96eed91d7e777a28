"""Declared schemas of the tables that pass between the stages, as Spark DDL."""

from __future__ import annotations

FILINGS_INDEX = "cik STRING, company_name STRING, form_type STRING, date_filed STRING, filename STRING"
FILINGS_RAW = "cik STRING, form STRING, accession STRING, path STRING, body STRING"
FILINGS_CLEAN = "cik STRING, accession STRING, filed_date DATE, text STRING"
SECTIONS = (
    "cik STRING, accession STRING, filed_date DATE, item_n STRING, start_line INT, end_line INT, text STRING"
)
PAIRS = "cik STRING, filing_a STRING, date_a DATE, filing_b STRING, date_b DATE"
SIMILARITY = (
    "ticker STRING, date_a DATE, date_b DATE, distance INT, similarity DOUBLE, "
    "len_a INT, len_b INT, sentiment DOUBLE"
)
RETURNS = "cik STRING, company_name STRING, date DATE, ret DOUBLE"
MONTHLY_STOCK = "permno BIGINT, date DATE, ret DOUBLE"
LINK_TABLE = (
    "lpermno BIGINT, gvkey STRING, linktype STRING, linkprim STRING, linkdt DATE, linkenddt DATE"
)
COMPANY = "gvkey STRING, cik STRING, conm STRING"
LEXICON = "word STRING, valence DOUBLE"
ITEMS = (
    "cik STRING, accession STRING, filed_date DATE, start_line INT, end_line INT, text STRING, status STRING, "
    "reason STRING, item_n STRING"
)
REJECTS = "cik STRING, accession STRING, reason STRING"
