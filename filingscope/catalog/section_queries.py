"""Heading repair and item sections: D1-D12, W4."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.catalog.registry import derived, query
from filingscope.operators import headings as hd
from filingscope.operators import sections as sec

derived(
    "broken_texts",
    """
    SELECT doc_id, text || chr(10) || ' I ' || chr(10) || '  tem 1. Business' || chr(10) || 'I' || chr(10) || text
      || chr(10) || 'Item' || chr(10) || '  2. Properties' || chr(10) || 'Items ' || chr(10) || 'none' || chr(10)
      || 'Item1A Item- Items(a)' || chr(10) || 'Item ' || CAST(doc_id % 12 AS STRING) || chr(10) || ' A. Risk'
      || chr(10) || text || chr(10) || 'Item 7' || chr(10) || '. Report' || chr(10) || 'Item 3B' || chr(10) || 'C. x' AS text
    FROM {documents}
    """,
)
STRIPPED = "trim(l, ' ' || chr(9) || chr(160))"
NEXT = "ltrim(coalesce(parts[i + 1], ''), ' ' || chr(9) || chr(160))"


def _merge_sql(head: str, tail: str, glue: str, source: str = "{broken_texts}") -> str:
    return f"""
    WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {source}),
    n AS (SELECT doc_id, parts, unnest(parts) AS l, generate_subscripts(parts, 1) AS i FROM p),
    m AS (SELECT doc_id, i, l, {STRIPPED} AS s, {NEXT} AS nx FROM n),
    f AS (SELECT *, {head} AND {tail} AS merged FROM m),
    g AS (SELECT *, coalesce(lag(merged) OVER (PARTITION BY doc_id ORDER BY i), false) AS swallowed FROM f)
    SELECT doc_id, string_agg(CASE WHEN merged THEN s || '{glue}' || nx ELSE l END, chr(10) ORDER BY i) AS text
    FROM g WHERE NOT swallowed GROUP BY doc_id
    """


def _repair(step):
    return lambda t: t["broken_texts"].select("doc_id", step(F.col("text")).alias("text"))


SPACE_SQL = r"""
    SELECT doc_id, regexp_replace(text, '(^|[^\pL\pN_])(Items?)([^\pL\pN_\s])', '\1\2 \3', 'g') AS text
    FROM SOURCE
"""
SPLIT_WORD = ("s = 'I'", "starts_with(nx, 'tem')", "")
NUMBER_LINE = ("s IN ('Item', 'Items')", "regexp_matches(nx, '^[0-9]')", " ")
SUFFIX_LINE = (r"regexp_matches(s, '^Item\s+[0-9]+$')", r"regexp_matches(nx, '^[A-Za-z]?\.')", "")

query("d1_merge_split_word", _repair(hd.merge_split_word), _merge_sql(*SPLIT_WORD))
query(
    "d2a_space_after_item",
    _repair(hd.space_after_item),
    SPACE_SQL.replace("SOURCE", "{broken_texts}"),
)
query(
    "d2b_merge_number_line",
    _repair(hd.merge_number_line),
    _merge_sql(*NUMBER_LINE),
)
query(
    "d2c_merge_suffix_line",
    _repair(hd.merge_suffix_line),
    _merge_sql(*SUFFIX_LINE),
)



def _all_repairs() -> str:
    once = f"({_merge_sql(*SPLIT_WORD)})"
    once = f"({SPACE_SQL.replace('SOURCE', once)})"
    return _merge_sql(*SUFFIX_LINE, source=f"({_merge_sql(*NUMBER_LINE, source=once)})")


query(
    "d_repair_headings",
    lambda t: hd.repair_headings(t["broken_texts"]).select("doc_id", "text"),
    _all_repairs(),
)

# A contents list, then the body: whole texts between item headings. Some filings lack the label that
# counts the rounds, some have no heading, some labels are ones the ladder does not know.
derived(
    "filing_texts",
    """
    SELECT source AS cik, lpad(CAST(doc_id AS STRING), 10, '0') || '-' || lpad(CAST(doc_id % 24 AS STRING), 2, '0')
        || '-000001' AS accession,
      CASE WHEN doc_id % 13 = 0 THEN text ELSE
        'header' || chr(10) || lpad(CAST(doc_id AS STRING), 10, '0') || '-' || lpad(CAST(doc_id % 24 AS STRING), 2, '0')
        || '-000001.txt : 20' || lpad(CAST(doc_id % 24 AS STRING), 2, '0') || lpad(CAST(doc_id % 13 AS STRING), 2, '0') || '21'
        || chr(10) || 'Item 1. Business' || chr(10) || 'Item 1A. Risk' || chr(10) || 'Item 2. Properties' || chr(10)
        || 'Item 7. Report' || chr(10) || 'Item 7A. Market' || chr(10) || 'Item 8. Statements' || chr(10)
        || CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'Item 9A. Controls' || chr(10) END || 'Item 10. Directors' || chr(10)
        || 'ITEM 1.  Business' || chr(10) || text || chr(10)
        || CASE doc_id % 5 WHEN 0 THEN 'Item 1A: Risk' WHEN 1 THEN 'Item1A. Risk' ELSE '  items' || chr(160) || '1a. Risk' END
        || chr(10) || text || chr(10) || 'Item 2.Properties' || chr(10) || 'item  2 Properties' || chr(10) || text || chr(10)
        || CASE WHEN doc_id % 7 = 0 THEN 'Item 400. of Regulation' ELSE 'Item x' END || chr(10)
        || 'Item 7. Report' || chr(10) || 'see Item 1. above' || chr(10) || 'Item 7A. Market' || chr(10) || text || chr(10)
        || CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'Item 9A. Controls' || chr(10) END || 'Item 10. Directors' || chr(10) || text
      END AS text
    FROM {documents}
    """,
)
derived(
    "text_lines_check",
    """
    SELECT cik, accession, unnest(parts) AS line, CAST(generate_subscripts(parts, 1) AS INT) AS line_no
    FROM (SELECT cik, accession, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS parts
          FROM (SELECT cik, accession, string_split(text, chr(10)) AS p FROM {filing_texts}))
    """,
)
derived(
    "all_heads_check",
    r"""
    SELECT * FROM (SELECT cik, accession, line_no, upper(regexp_extract(
        trim(regexp_replace(replace(line, chr(160), ' '), '\s+', ' ', 'g')), '(?i)^items?\b ?([0-9][^ .]*)', 1)) AS item_n
      FROM {text_lines_check}) WHERE item_n <> ''
    """,
)
derived(
    "heads_check",
    """
    SELECT cik, accession, line_no, item_n, CAST(regexp_replace(item_n, '[^0-9]', '', 'g') AS INT) AS num
    FROM (SELECT *, lag(item_n) OVER (PARTITION BY accession ORDER BY line_no) AS previous FROM {all_heads_check})
    WHERE previous IS NULL OR previous <> item_n
    """,
)
derived(
    "rounds_check",
    """
    SELECT accession, top, CAST(count(*) FILTER (num = top - 1) AS INT) AS rounds
    FROM (SELECT accession, num, max(num) OVER (PARTITION BY accession) AS top FROM {heads_check} WHERE num <= 20)
    GROUP BY accession, top
    """,
)
derived(
    "ladder_check",
    """
    SELECT l AS label, row_number() OVER () AS pos, 8 AS needs
    FROM (SELECT unnest(['1','1A','1B','1C','1D','2','3','4','5','6','7','7A','8']) AS l)
    UNION ALL SELECT CAST(n AS STRING) || x, 13 + (n - 9) * 4 + xi, n
    FROM (SELECT unnest(range(9, 21)) AS n), (SELECT unnest(['', 'A', 'B', 'C']) AS x, generate_subscripts(['', 'A', 'B', 'C'], 1) AS xi)
    """,
)
derived(
    "steps_check",
    """
    SELECT accession, r, label, row_number() OVER (PARTITION BY accession ORDER BY r, pos) AS k
    FROM (SELECT accession, top, unnest(range(1, rounds + 1)) AS r FROM {rounds_check})
    JOIN {ladder_check} ON needs <= greatest(top, 8)
    """,
)
WALK = """
    WITH RECURSIVE walk AS (
      SELECT accession, CAST(0 AS BIGINT) AS k, 0 AS last, CAST(NULL AS INT) AS hit FROM {rounds_check} WHERE rounds > 0
      UNION ALL
      SELECT w.accession, s.k, coalesce(min(h.line_no), any_value(w.last)), min(h.line_no)
      FROM walk w JOIN {steps_check} s ON s.accession = w.accession AND s.k = w.k + 1
      LEFT JOIN {heads_check} h ON h.accession = w.accession AND h.item_n = s.label AND h.line_no > w.last
      GROUP BY w.accession, s.k
    ),
    taken AS (SELECT accession, r, label AS item_n, hit AS line_no FROM walk JOIN {steps_check} USING (accession, k)),
    stretched AS (
      SELECT accession, r, count(line_no) AS n,
        max(line_no) - list_sort(list(line_no) FILTER (line_no IS NOT NULL))[2] AS stretch
      FROM taken GROUP BY accession, r),
    best AS (
      SELECT accession, arg_min(r, (-stretch, r)) AS r FROM stretched
      GROUP BY accession HAVING min(n) >= 2 AND max(stretch) > 0),
    chosen AS (
      SELECT accession, item_n, line_no AS start_line,
        lead(line_no) OVER (PARTITION BY accession ORDER BY line_no) AS next_line
      FROM taken JOIN best USING (accession, r) WHERE line_no IS NOT NULL),
    ends AS (SELECT accession, max(line_no) + 1 AS eof FROM {text_lines_check} GROUP BY accession),
"""
SECTION_SQL = """
    spans AS (SELECT accession, item_n, start_line, greatest(coalesce(next_line, %s), start_line) AS stop
      FROM chosen JOIN ends USING (accession))
    SELECT s.accession, s.item_n, s.start_line, s.stop - 1 AS end_line,
      coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no), '') AS text
    FROM spans s LEFT JOIN {text_lines_check} l
      ON l.accession = s.accession AND l.line_no >= s.start_line AND l.line_no < s.stop
    GROUP BY ALL
"""


def _texts(t):
    return t["filing_texts"].withColumn("filed_date", sec.filing_date(F.col("text"), F.col("accession")))


def _outline(t):
    return sec.outline_filings(_texts(t))


query(
    "d3_line_split",
    lambda t: t["filing_texts"].select(
        "accession", F.posexplode(sec.lines(F.col("text"))).alias("i", "line")
    ).select("accession", (F.col("i") + 1).alias("line_no"), "line"),
    "SELECT accession, line_no, line FROM {text_lines_check}",
)
query(
    "d4_headings",
    lambda t: t["filing_texts"].select(
        "accession", F.explode(sec.all_headings(sec.lines(F.col("text")))).alias("h")
    ).select("accession", "h.*"),
    "SELECT accession, item_n, line_no FROM {all_heads_check}",
)
query(
    "d5_filing_date",
    lambda t: _texts(t).select("accession", "filed_date"),
    """
    SELECT accession, TRY_CAST(regexp_replace(d, '(....)(..)(..)', '\\1-\\2-\\3') AS DATE) AS filed_date
    FROM (SELECT t.accession, regexp_extract(l.line, '^[^:]*:\\s*([0-9]{{8}})', 1) AS d
      FROM {filing_texts} t LEFT JOIN (
        SELECT accession, arg_min(line, line_no) AS line FROM {text_lines_check}
        WHERE contains(lower(line), accession) GROUP BY accession) l USING (accession))
    """.replace("{{8}}", "{8}"),
)
HEADS_SQL = "SELECT accession, item_n, line_no FROM {heads_check}"


def _deduped(t):
    return t["filing_texts"].select(
        "accession", F.explode(sec.drop_repeats(sec.all_headings(sec.lines(F.col("text"))))).alias("h")
    ).select("accession", "h.*")


query("d6_drop_repeated_headings", _deduped, HEADS_SQL)
query("w4_consecutive_headings", _deduped, HEADS_SQL)
query(
    "d7_round_count",
    lambda t: _outline(t).filter(F.col("rounds").isNotNull()).select("accession", "rounds"),
    "SELECT accession, rounds FROM {rounds_check}",
)
query(
    "d7_round_count_fallback",
    lambda t: sec.outline_filings(_texts(t), rounds="max_or_previous")
    .filter(F.col("rounds").isNotNull()).select("accession", "rounds"),
    """
    SELECT r.accession, CASE WHEN rounds > 0 THEN rounds ELSE CAST(count(*) AS INT) END AS rounds
    FROM {rounds_check} r JOIN {heads_check} h ON h.accession = r.accession AND h.num = r.top
    GROUP BY r.accession, rounds
    """,
)
query(
    "d8_label_ladder",
    lambda t: t["orders"].select("o_orderkey", (F.col("o_orderkey") % 21).cast("int").alias("top")).select(
        "o_orderkey", F.array_join(sec.label_ladder(F.col("top")), ",").alias("ladder")
    ),
    """
    SELECT o_orderkey, string_agg(label, ',' ORDER BY pos) AS ladder
    FROM orders JOIN {ladder_check} ON needs <= greatest(o_orderkey % 21, 8) GROUP BY o_orderkey
    """,
)
query(
    "d9_rounds",
    lambda t: _outline(t).filter("rounds > 0")
    .select("accession", F.posexplode(sec.build_rounds(
        F.col("headings"), sec.label_ladder(F.array_max(sec.plausible_numbers(sec.item_numbers(F.col("headings"))))),
        F.col("rounds"),
    )).alias("r", "taken"))
    .select("accession", (F.col("r") + 1).alias("r"), F.explode("taken").alias("h"))
    .select("accession", "r", "h.*"),
    WALK + """
    short AS (SELECT accession, min(r) AS r FROM stretched WHERE n < 2 GROUP BY accession)
    SELECT t.accession, t.r, item_n, line_no FROM taken t LEFT JOIN short s ON s.accession = t.accession
    WHERE line_no IS NOT NULL AND (s.r IS NULL OR t.r <= s.r)
    """,
)
query(
    "d10_best_round",
    lambda t: _outline(t).select("accession", F.explode("chosen").alias("h")).select("accession", "h.*"),
    WALK + "done AS (SELECT 1) SELECT accession, item_n, start_line AS line_no FROM chosen",
)
query(
    "d11_sections",
    lambda t: sec.sections(sec.split_items(_texts(t))).select("accession", "item_n", "start_line", "end_line", "text"),
    WALK + SECTION_SQL % "eof",
)
query(
    "d11_sections_fixed_end",
    lambda t: sec.sections(sec.split_items(_texts(t), last_line=sec.FIXED_LAST_LINE))
    .select("accession", "item_n", "start_line", "end_line", "text"),
    WALK + SECTION_SQL % "least(eof, 11849)",
)
query(
    "d12_rejects",
    lambda t: sec.rejects(sec.split_items(_texts(t))).select("accession", "reason"),
    WALK + """
    counted AS (SELECT t.accession, h.n, r.rounds, b.r AS best FROM {filing_texts} t
      LEFT JOIN (SELECT accession, count(*) AS n FROM {heads_check} GROUP BY accession) h USING (accession)
      LEFT JOIN {rounds_check} r USING (accession) LEFT JOIN best b USING (accession))
    SELECT accession, CASE WHEN n IS NULL THEN 'no_headings' WHEN rounds IS NULL THEN 'no_plausible_item_number'
      WHEN rounds = 0 THEN 'no_round' ELSE 'no_usable_round' END AS reason FROM counted WHERE best IS NULL
    """,
)
