"""Filing indexes: S1-S6, S11, S12, P1-P10, P18-P20, W1, J5, A9, O4, O5."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.catalog.registry import derived, query
from filingscope.functions import dates
from filingscope.functions.ordered import stored
from filingscope.operators import audit
from filingscope.plans.study import Study
from filingscope.schemas import RETURNS
from filingscope.session import work_folder
from filingscope.sources import filings, index, tables

derived(
    "index_rows",
    """
    SELECT o_orderkey AS id,
      lpad(CAST(o_custkey AS STRING), 10, '0') AS cik,
      CASE o_custkey % 4 WHEN 0 THEN 'Acme ' WHEN 1 THEN ' alpha ' WHEN 2 THEN 'Beta ' ELSE 'Gamma ' END
        || CAST(o_custkey AS STRING) AS company_name,
      CASE o_orderkey % 6 WHEN 0 THEN '10-K' WHEN 1 THEN '10-K/A' WHEN 2 THEN '10KSB' WHEN 3 THEN '10-KT'
        WHEN 4 THEN '8-K' ELSE '10-Q' END AS form_type,
      CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_filed,
      'edgar/data/' || CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey AS STRING) || '.txt' AS filename
    FROM {orders}
    """,
)
# One small index file per order: a header, a good line, a short line, and lines a parser must skip.
derived(
    "index_files",
    """
    SELECT id, 'master_' || CAST(id AS STRING) || '.idx' AS source_file,
      'Master index' || chr(10) || 'a|b|c|d|e' || chr(13) || chr(10)
        || CASE WHEN id % 10 = 0 THEN 'no header' ELSE 'CIK|Company Name|Form Type|Date Filed|Filename' END
        || chr(10) || '--------' || chr(10)
        || cik || '|' || company_name || '|' || form_type || '|' || date_filed || '|' || filename || chr(10)
        || 'bad|' || cik || chr(10) || 'no separator' || chr(10) AS body
    FROM {index_rows}
    """,
)
derived(
    "index_numbered_check",
    """
    SELECT source_file, CAST(i AS INT) AS line_no, parts[i] AS line, string_split(parts[i], '|') AS fields
    FROM (SELECT source_file, parts, unnest(range(1, len(parts) + 1)) AS i
          FROM (SELECT source_file, string_split(replace(body, chr(13), ''), chr(10)) AS parts FROM {index_files}))
    """,
)
derived(
    "index_headers_check",
    "SELECT source_file, min(line_no) AS header FROM {index_numbered_check} WHERE line LIKE 'CIK|%' GROUP BY source_file",
)

FIELD_SQL = (
    "fields[1] AS cik, fields[2] AS company_name, fields[3] AS form_type, fields[4] AS date_filed, "
    "fields[5] AS filename"
)
query(
    "s1_index_strict",
    lambda t: index.parse_index(t["index_files"]),
    f"""
    SELECT source_file, line_no, {FIELD_SQL} FROM {{index_numbered_check}} JOIN {{index_headers_check}} USING (source_file)
    WHERE line_no > header AND len(fields) = 5
    """,
)
query(
    "s2_index_lenient",
    lambda t: index.parse_index(t["index_files"], strict=False),
    f"""
    SELECT source_file, line_no, {FIELD_SQL} FROM {{index_numbered_check}}
    WHERE line NOT LIKE 'CIK|%' AND len(fields) = 5
    """,
)
query(
    "s2_index_rejects",
    lambda t: index.index_rejects(t["index_files"], strict=False),
    """
    SELECT source_file, line_no, line, 'field_count' AS reason FROM {index_numbered_check}
    WHERE line NOT LIKE 'CIK|%' AND len(fields) > 1 AND len(fields) <> 5
    """,
)
query(
    "s3_union_provenance",
    lambda t: index.parse_index(t["index_files"])
    .groupBy(F.substring("source_file", 1, 8).alias("file_prefix"), "form_type")
    .agg(F.count("*").alias("n"), F.countDistinct("source_file").alias("files")),
    """
    SELECT substr(source_file, 1, 8) AS file_prefix, fields[3] AS form_type, count(*) AS n,
      count(DISTINCT source_file) AS files
    FROM {index_numbered_check} JOIN {index_headers_check} USING (source_file)
    WHERE line_no > header AND len(fields) = 5 GROUP BY 1, 2
    """,
)

derived(
    "tree_files",
    """
    SELECT '/data/html/' || CAST(o_custkey AS STRING) || '/10-K/' || lpad(CAST(o_custkey AS STRING), 10, '0')
        || '-' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 3, 2) || '-'
        || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') || '/full-submission.txt' AS path
    FROM {orders}
    """,
)
# Landed filings; one in nine has an accession that is none, years lie on both sides of 2000.
derived(
    "landed",
    """
    SELECT lpad(CAST(o_custkey AS STRING), 10, '0') AS cik, CAST(o_orderdate AS DATE) AS filed_date,
      CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE '' END || lpad(CAST(o_custkey AS STRING), 10, '0') || '-'
        || CASE WHEN o_orderkey % 2 = 0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 3, 2)
             ELSE lpad(CAST(o_orderkey % 70 AS STRING), 2, '0') END
        || '-' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') AS accession,
      o_orderkey AS id
    FROM {orders}
    """,
)
derived("filers", "SELECT CAST(c_custkey AS STRING) || ' ' AS CIK, c_mktsegment AS segment FROM {customer}")
YEAR_SQL = """
    CASE WHEN regexp_matches(accession, '^[0-9]{10}-[0-9]{2}-[0-9]{6}$')
      THEN CAST(substr(accession, 12, 2) AS INT)
        + CASE WHEN CAST(substr(accession, 12, 2) AS INT) >= 70 THEN 1900 ELSE 2000 END END
"""
query(
    "s4_filing_tree",
    lambda t: filings.with_tree_keys(t["tree_files"]).select("path", "cik", "form", "accession"),
    """
    SELECT path, lpad(split_part(path, '/', 4), 10, '0') AS cik, split_part(path, '/', 5) AS form,
      split_part(path, '/', 6) AS accession FROM {tree_files}
    """,
)
query(
    "s5_filer_list",
    lambda t: index.filer_list(t["filers"]),
    "SELECT lpad(trim(CIK), 10, '0') AS cik FROM {filers}",
)
derived(
    "return_lines",
    """
    SELECT CAST(o_custkey AS STRING) || ',Firm ' || CAST(o_custkey AS STRING) || ','
      || CAST(CAST(o_orderdate AS DATE) AS STRING) || ','
      || CASE WHEN o_orderkey % 5 = 0 THEN 'NaN' WHEN o_orderkey % 7 = 0 THEN ''
           ELSE '0.' || CAST(o_orderkey % 89 + 10 AS STRING) END AS line
    FROM {orders}
    """,
)
query(
    "s6_csv_typed",
    lambda t: tables.parse_csv(t["return_lines"], "line", RETURNS),
    """
    SELECT lpad(split_part(line, ',', 1), 10, '0') AS cik, split_part(line, ',', 2) AS company_name,
      CAST(split_part(line, ',', 3) AS DATE) AS date,
      CAST(nullif(nullif(split_part(line, ',', 4), 'NaN'), '') AS DOUBLE) AS ret FROM {return_lines}
    """,
)
# The same lines with an index column in front and the others in another order, some with a value that does not fit.
derived(
    "named_lines",
    """
    SELECT concat(CAST(o_orderkey AS STRING), ',', CASE WHEN o_orderkey % 13 = 0 THEN 'no date'
        ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END, ',', CASE WHEN o_orderkey % 11 = 0 THEN 'x1'
        ELSE concat('0.', CAST(o_orderkey % 89 + 10 AS STRING)) END, ',', CAST(o_custkey AS STRING), ',', o_orderpriority) AS line
    FROM {orders}
    """,
)
query(
    "s6_csv_by_name",
    lambda t: tables.parse_csv(t["named_lines"], "line", RETURNS, header=",date,ret,cik,company_name"),
    """
    SELECT lpad(split_part(line, ',', 4), 10, '0') AS cik, split_part(line, ',', 5) AS company_name,
      TRY_CAST(split_part(line, ',', 2) AS DATE) AS date, TRY_CAST(split_part(line, ',', 3) AS DOUBLE) AS ret FROM {named_lines}
    """,
)
query(
    "s11_landed_filers",
    lambda t: audit.landed_filers(index.filer_list(t["filers"]), t["landed"]),
    """
    SELECT lpad(trim(CIK), 10, '0') AS cik FROM {filers}
    WHERE lpad(trim(CIK), 10, '0') IN (SELECT cik FROM {landed})
    """,
)
derived("landed_ok", "SELECT cik, accession FROM {landed} WHERE accession NOT LIKE 'x%'")
STATUS_SQL = """
    SELECT lpad(trim(CIK), 10, '0') AS cik,
      CASE WHEN lpad(trim(CIK), 10, '0') IN (SELECT cik FROM {landed} WHERE accession LIKE 'x%') THEN 'error'
        WHEN lpad(trim(CIK), 10, '0') IN (SELECT cik FROM {landed_ok}) THEN 'ok' ELSE 'not_found' END AS status
    FROM {filers}
"""


def _status(t):
    return audit.ingest_status(
        index.filer_list(t["filers"]), t["landed_ok"], filings.bad_accessions(t["landed"])
    )


query("s12_ingest_status", _status, STATUS_SQL)
query(
    "s12_ingest_counts",
    lambda t: audit.status_counts(_status(t)),
    f"SELECT status, count(*) AS n FROM ({STATUS_SQL}) GROUP BY status",
)

query(
    "p1_exact_forms",
    lambda t: index.keep_forms(t["index_rows"]),
    "SELECT * FROM {index_rows} WHERE form_type IN ('10-K', '10KSB', '10-KT')",
)
query(
    "p2_form_prefix",
    lambda t: index.form_prefix(t["index_rows"]),
    "SELECT * FROM {index_rows} WHERE form_type LIKE '10-K%'",
)
query(
    "p3_filed_between",
    lambda t: index.filed_between(t["index_rows"], "1994-02-01", "1996-07-15"),
    "SELECT * FROM {index_rows} WHERE CAST(date_filed AS DATE) BETWEEN DATE '1994-02-01' AND DATE '1996-07-15'",
)
query(
    "p4_name_prefix",
    lambda t: index.name_prefix(t["index_rows"]),
    "SELECT * FROM {index_rows} WHERE upper(trim(company_name)) LIKE 'A%'",
)
query(
    "p5_urls",
    lambda t: index.filing_urls(t["index_rows"], "https://example.org/Archives/"),
    "SELECT 'https://example.org/Archives/' || filename AS url FROM {index_rows}",
)
query(
    "p6_accession_year",
    lambda t: t["landed"].select("id", "accession", dates.accession_year(F.col("accession")).alias("year")),
    f"SELECT id, accession, {YEAR_SQL} AS year FROM {{landed}}",
)
query(
    "p6_bad_accessions",
    lambda t: filings.bad_accessions(t["landed"]),
    f"SELECT cik, accession, 'bad_accession' AS reason FROM {{landed}} WHERE ({YEAR_SQL}) IS NULL",
)
query(
    "p7_year_cutoff",
    lambda t: filings.from_year(t["landed"]),
    f"SELECT * FROM {{landed}} WHERE ({YEAR_SQL}) >= 2006",
)
query(
    "p8_start_date",
    lambda t: filings.filed_from(t["landed"], "1995-06-01"),
    "SELECT * FROM {landed} WHERE filed_date >= DATE '1995-06-01'",
)
LATEST_SQL = """
    SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER
      (PARTITION BY cik ORDER BY filed_date DESC, accession DESC) AS r FROM {landed}) WHERE r <= %d
"""
query("p9_latest_per_filer", lambda t: filings.latest_filings(t["landed"], 5), LATEST_SQL % 5)
query("o5_limit_per_filer", lambda t: filings.latest_filings(t["landed"]), LATEST_SQL % 20)
query(
    "p10_key_padding",
    lambda t: t["orders"].select(
        "o_orderkey",
        dates.normalise_cik(F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("cik"),
        dates.normalise_cik(F.col("o_orderkey") * 100000000000).alias("long_key"),
    ),
    """
    SELECT o_orderkey, lpad(CAST(o_custkey AS STRING), 10, '0') AS cik,
      CASE WHEN length(CAST(o_orderkey * 100000000000 AS STRING)) >= 10
        THEN CAST(o_orderkey * 100000000000 AS STRING)
        ELSE lpad(CAST(o_orderkey * 100000000000 AS STRING), 10, '0') END AS long_key FROM orders
    """,
)
query(
    "p18_chosen_filers",
    lambda t: index.only_filers(t["landed"], ["7", " 11", "0000000013"]),
    "SELECT * FROM {landed} WHERE cik IN ('0000000007', '0000000011', '0000000013')",
)
query(
    "p18_filers_from_table",
    lambda t: index.only_filers(t["landed"], t["filers"].filter("segment = 'BUILDING'")),
    """
    SELECT * FROM {landed}
    WHERE cik IN (SELECT lpad(trim(CIK), 10, '0') FROM {filers} WHERE segment = 'BUILDING')
    """,
)
query(
    "p19_pick_rename",
    lambda t: t["landed"].select("cik", "filed_date", "id").withColumnRenamed("id", "pair_id").drop("filed_date"),
    "SELECT cik, id AS pair_id FROM {landed}",
)
query(
    "p20_date_parts",
    lambda t: t["landed"]
    .withColumn("compact", F.regexp_replace(dates.iso_date(F.col("filed_date")), "-", ""))
    .select("id", dates.iso_date(F.col("filed_date")).alias("iso"), *[
        part.alias(name) for name, part in dates.compact_date_parts(F.col("compact")).items()
    ]),
    """
    SELECT id, strftime(filed_date, '%Y-%m-%d') AS iso, strftime(filed_date, '%Y') AS year,
      strftime(filed_date, '%m') AS month, strftime(filed_date, '%d') AS day FROM {landed}
    """,
)

derived(
    "ordered_index",
    """
    SELECT o_orderkey AS line_no, o_orderpriority AS cik,
      'q' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) AS source_file FROM {orders}
    """,
)
query(
    "w1_first_of_block",
    lambda t: index.first_of_each_block(t["ordered_index"]),
    """
    SELECT source_file, line_no, cik FROM (
      SELECT *, lag(cik) OVER (ORDER BY source_file, line_no) AS previous FROM {ordered_index})
    WHERE previous IS NULL OR previous <> cik
    """,
)
query(
    "o4_union_all",
    lambda t: index.union_sources([
        t["index_rows"].select("cik", "form_type"), t["landed"].select("cik", "accession")
    ]),
    """
    SELECT cik, form_type, NULL AS accession FROM {index_rows}
    UNION ALL SELECT cik, NULL, accession FROM {landed}
    """,
)

derived(
    "audit_similarity",
    """
    SELECT CAST(o_custkey AS STRING) AS ticker, CAST(o_orderdate AS DATE) AS date_a,
      CAST(o_orderdate AS DATE) - 400 AS date_b FROM {orders} WHERE o_orderstatus = 'F'
    """,
)
derived(
    "audit_filings",
    """
    SELECT cik, lpad(cik, 10, '0') || '-' || substr(CAST(filed_date AS STRING), 3, 2) || '-'
      || lpad(CAST(id % 1000000 AS STRING), 6, '0') AS accession FROM {landed}
    """,
)
query(
    "j5_coverage_gaps",
    lambda t: audit.coverage_gaps(t["audit_filings"], t["audit_similarity"]),
    """
    WITH s AS (SELECT lpad(ticker, 10, '0') AS cik, date_a, date_b FROM {audit_similarity}),
    oldest AS (SELECT cik, date_b, row_number() OVER (PARTITION BY cik ORDER BY date_a, date_b) AS r FROM s),
    covered AS (SELECT cik, year(date_a) AS year FROM s UNION SELECT cik, year(date_b) FROM oldest WHERE r = 1),
    f AS (SELECT cik, CAST(substr(accession, 12, 2) AS INT)
            + CASE WHEN CAST(substr(accession, 12, 2) AS INT) >= 70 THEN 1900 ELSE 2000 END AS year
          FROM {audit_filings})
    SELECT cik, year FROM f WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.cik = f.cik AND c.year = f.year)
    """,
)
query(
    "a9_row_counts",
    lambda t: index.union_sources([
        t["index_rows"].agg(F.lit("read").alias("step"), F.count("*").alias("rows")),
        index.keep_forms(t["index_rows"]).agg(F.lit("kept").alias("step"), F.count("*").alias("rows")),
        index.first_of_each_block(t["ordered_index"]).agg(F.lit("deduped").alias("step"), F.count("*").alias("rows")),
    ]),
    """
    SELECT 'read' AS step, count(*) AS rows FROM {index_rows}
    UNION ALL SELECT 'kept', count(*) FROM {index_rows} WHERE form_type IN ('10-K', '10KSB', '10-KT')
    UNION ALL SELECT 'deduped', count(*) FROM (
      SELECT cik, lag(cik) OVER (ORDER BY source_file, line_no) AS previous FROM {ordered_index})
      WHERE previous IS NULL OR previous <> cik
    """,
)
derived(
    "listed_index",
    """
    SELECT o_orderkey AS line_no, o_orderpriority AS cik, 'q' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) AS source_file,
      CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-K405' ELSE '10-KT' END AS form_type FROM {orders}
    """,
)
query(
    "a9_step_counts",
    lambda t: audit.step_counts(
        t["listed_index"], [("kept", index.keep_forms), ("deduped", lambda kept: index.first_of_each_block(stored(kept)))]
    ),
    """
    WITH kept AS (SELECT * FROM {listed_index} WHERE form_type IN ('10-K', '10KSB', '10-KT'))
    SELECT 'read' AS step, count(*) AS rows FROM {listed_index}
    UNION ALL SELECT 'kept', count(*) FROM kept
    UNION ALL SELECT 'deduped', count(*) FROM (SELECT cik, lag(cik) OVER (ORDER BY source_file, line_no) AS previous FROM kept)
      WHERE previous IS NULL OR previous <> cik
    """,
)


def _read_quarters(t):
    """Index files written as text, one of each month, and read in one go."""
    folder = work_folder(t.spark)
    t["month_files"].repartition("source_file").write.partitionBy("source_file").option("lineSep", "\n").text(folder)
    files = index.read_index_files(t.spark, folder)
    return index.parse_index(files).drop("source_file")


# An index file for each month: a header and a line for each order.
derived(
    "month_files",
    f"""
    SELECT 'q' || substr(date_filed, 1, 7) AS source_file, 'Master index' || chr(10) || 'CIK|Company Name|Form Type|Date Filed|Filename' || chr(10)
      || array_to_string(list(line ORDER BY id), chr(10)) AS body
    FROM (SELECT id, date_filed, cik || '|' || company_name || '|' || form_type || '|' || date_filed || '|' || filename AS line FROM {{index_rows}})
    GROUP BY 1, date_filed[1:7]
    """,
    lambda t: t["index_rows"]
    .groupBy(F.concat(F.lit("q"), F.substring("date_filed", 1, 7)).alias("source_file"))
    .agg(F.sort_array(F.collect_list(F.struct("id", F.concat_ws("|", "cik", "company_name", "form_type", "date_filed", "filename").alias("line")))).alias("of"))
    .select("source_file", F.concat(F.lit("Master index\nCIK|Company Name|Form Type|Date Filed|Filename\n"), F.array_join("of.line", "\n")).alias("body")),
)
query(
    "s3_index_files",
    _read_quarters,
    """
    SELECT CAST(2 + row_number() OVER (PARTITION BY date_filed[1:7] ORDER BY id) AS INT) AS line_no, cik, company_name, form_type, date_filed, filename
    FROM {index_rows}
    """,
)
derived(
    "submissions",
    """
    SELECT lpad(CAST(doc_id % 97 AS STRING), 10, '0') AS cik,
      lpad(CAST(doc_id % 97 AS STRING), 10, '0') || '-07-' || lpad(CAST(doc_id AS STRING), 6, '0') AS accession, text AS body
    FROM {documents} WHERE length(text) > 0
    """,
)


def _landed_and_read(t):
    """Whole documents landed as a tree of submissions and read back."""
    folder = work_folder(t.spark)
    filings.write_filings(t["submissions"], f"file:{folder}" if folder.startswith("/") else folder)
    return filings.read_filings(t.spark, folder).select("cik", "form", "accession", F.md5(F.col("body")).alias("digest"))


query("s4_landed_filings", _landed_and_read, "SELECT cik, '10-K' AS form, accession, md5(body) AS digest FROM {submissions}")
derived(
    "return_rows",
    """
    SELECT lpad(CAST(o_custkey AS STRING), 10, '0') AS cik, 'Firm, "' || o_clerk_name || '"' AS company_name, CAST(o_orderdate AS DATE) AS date,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 89 AS DOUBLE) / 100 END AS ret
    FROM (SELECT *, o_orderpriority AS o_clerk_name FROM {orders})
    """,
)


def _written_csv(t):
    folder = work_folder(t.spark)
    tables.write_csv(t["return_rows"], folder)
    return tables.read_csv(t.spark, folder, RETURNS)


query("s7_csv_written", _written_csv, "SELECT * FROM {return_rows}")


def _cleaned(t):
    """The study's cleaning stage over landed documents, read back with its declared schema."""
    study = Study(t.spark, work_folder(t.spark))
    raw = t["submissions"].withColumn("form", F.lit("10-K")).withColumn("path", F.col("accession"))
    marked = raw.withColumn("body", F.concat(F.lit("<html><body><p>"), F.translate("body", "<>&\r\xa0", ""), F.lit("</p></body></html>")))
    return study.clean(marked).select("cik", "accession", F.length(F.regexp_replace("text", r"[^A-Za-z0-9]", "")).alias("n"), F.col("filed_date").isNull().alias("undated"))


query(
    "s8_cleaned_filings",
    _cleaned,
    "SELECT cik, accession, length(regexp_replace(body, '[^A-Za-z0-9]', '', 'g')) AS n, TRUE AS undated FROM {submissions}",
)


def _items_written(t):
    """Items written with one folder for each label; only that of the asked label is read."""
    folder = work_folder(t.spark)
    tables.write_sections(t["labelled_items"], folder)
    return t.spark.read.schema("cik STRING, accession STRING, text STRING, item_n STRING").parquet(folder).filter("item_n = '1A'")


derived(
    "labelled_items",
    """
    SELECT cik, accession, body AS text, CASE CAST(right(accession, 6) AS INT) % 4 WHEN 0 THEN '1A' WHEN 1 THEN '7' WHEN 2 THEN '1' ELSE '10' END AS item_n
    FROM {submissions}
    """,
)
query("s9_items_written", _items_written, "SELECT cik, accession, text, item_n FROM {labelled_items} WHERE item_n = '1A'")
