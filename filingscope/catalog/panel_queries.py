"""Pair filters, returns, panel and features: S10, P11-P17, J1-J4, A1-A4, A8, W3, O2, F1-F6."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.catalog.registry import derived, query
from filingscope.functions import dates
from filingscope.operators import pairs as pr
from filingscope.operators import panel as pn
from filingscope.operators import quantiles as qt
from filingscope.operators import returns as rt
from filingscope.plans import models

derived(
    "pair_rows",
    """
    SELECT o_orderkey AS id, lpad(CAST(o_custkey AS STRING), 10, '0') AS ticker, CAST(o_orderdate AS DATE) AS date_a,
      CAST(o_orderdate AS DATE) - CAST(o_orderkey % 701 - 50 AS INT) AS date_b,
      CAST(o_orderkey % 300 AS INT) AS distance, CAST(o_orderkey % 997 AS DOUBLE) / 997 AS similarity,
      CAST(o_orderkey % 331 AS INT) AS len_a, CAST(o_orderkey * 7 % 283 AS INT) AS len_b,
      CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(o_custkey % 21 - 10 AS DOUBLE) / 10 END AS sentiment
    FROM {orders}
    """,
)
derived(
    "pair_texts_dated",
    """
    SELECT id, ticker, len_a, len_b,
      CASE id % 4 WHEN 0 THEN iso_a WHEN 1 THEN substr(iso_a, 9, 2) || '/' || substr(iso_a, 6, 2) || '/' || substr(iso_a, 1, 4)
        WHEN 2 THEN substr(iso_a, 9, 2) || '.' || substr(iso_a, 6, 2) || '.' || substr(iso_a, 1, 4) ELSE iso_a || ' 00:00:00' END AS date_a,
      CASE WHEN id % 9 = 0 THEN 'unknown' ELSE CAST(date_b AS STRING) END AS date_b
    FROM (SELECT *, CAST(date_a AS STRING) AS iso_a FROM {pair_rows})
    """,
)
derived(
    "firm_returns",
    """
    SELECT lpad(CAST(l_partkey AS STRING), 10, '0') AS cik,
      CASE WHEN l_linenumber = 3 THEN CAST(date_trunc('month', l_shipdate) AS DATE) ELSE CAST(l_shipdate AS DATE) END AS date,
      CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber = 5 THEN CAST('NaN' AS DOUBLE) ELSE l_discount - 0.05 END AS ret
    FROM {lineitem}
    """,
)
derived(
    "stock",
    """
    SELECT l_suppkey AS permno, CAST(l_shipdate AS DATE) AS date,
      CASE WHEN l_linenumber = 4 THEN NULL ELSE l_discount - 0.05 END AS ret, l_orderkey * 10 + l_linenumber AS row_key
    FROM {lineitem}
    """,
)
derived(
    "links",
    """
    SELECT s_suppkey AS lpermno, 'g' || CAST(s_nationkey AS STRING) AS gvkey,
      CASE s_suppkey % 4 WHEN 0 THEN 'LU' WHEN 1 THEN 'LC' WHEN 2 THEN 'LU' ELSE 'LX' END AS linktype,
      CASE s_suppkey % 5 WHEN 0 THEN 'J' WHEN 1 THEN 'C' ELSE 'P' END AS linkprim,
      DATE '1993-01-01' + CAST(s_suppkey % 500 AS INT) AS linkdt,
      CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE DATE '1996-01-01' + CAST(s_suppkey % 700 AS INT) END AS linkenddt
    FROM {supplier}
    UNION ALL
    SELECT s_suppkey, 'g' || CAST(s_nationkey AS STRING), 'LC', 'P', DATE '1995-01-01', DATE '1995-12-31'
    FROM {supplier} WHERE s_acctbal > 5000
    """,
)
derived(
    "companies",
    "SELECT 'g' || CAST(n_nationkey AS STRING) AS gvkey, CAST(n_nationkey AS STRING) AS cik, n_name AS conm FROM {nation}",
)
derived("wanted_filers", "SELECT CAST(n_nationkey AS STRING) AS cik FROM {nation} WHERE n_regionkey <> 2")

LINK_SQL = """
    SELECT lpad(c.cik, 10, '0') AS cik, c.conm AS company_name, m.date, m.ret
    FROM {stock} m JOIN {links} l ON m.permno = l.lpermno JOIN {companies} c ON l.gvkey = c.gvkey
    WHERE m.date >= DATE '1992-06-01' AND m.date <= DATE '1998-03-31' AND l.linktype IN ('LU', 'LC')
      AND l.linkprim IN ('P', 'C') AND m.date >= l.linkdt AND (m.date <= l.linkenddt OR l.linkenddt IS NULL)
"""
query(
    "j1_link_returns",
    lambda t: rt.link_returns(t["stock"], t["links"], t["companies"], first="1992-06-01", last="1998-03-31"),
    LINK_SQL,
)
query(
    "j1_all_dates",
    lambda t: rt.link_returns(t["stock"], t["links"], t["companies"]),
    LINK_SQL.replace("m.date >= DATE '1992-06-01' AND m.date <= DATE '1998-03-31' AND ", ""),
)
query(
    "s10_returns_of_filers",
    lambda t: rt.link_returns(
        t["stock"], t["links"], t["companies"], t["wanted_filers"], first="1992-06-01", last="1998-03-31"
    ),
    LINK_SQL + " AND c.cik IN (SELECT cik FROM {wanted_filers})",
)
query(
    "p11_long_enough",
    lambda t: pr.long_enough(t["pair_rows"]),
    "SELECT * FROM {pair_rows} WHERE len_a >= 75 AND len_b >= 75",
)
query(
    "p12_close_enough",
    lambda t: pr.close_enough(t["pair_rows"]),
    "SELECT * FROM {pair_rows} WHERE date_a - date_b < 500",
)
# One date a row in eleven ways of writing; kind 3 has the month first, kind 8 the day, kind 10 is no date.
_FORMATS = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d", "%m/%d/%Y", "%Y%m%d", "%d %b %Y", "%B %d, %Y", "%b %d, %Y", "%d/%m/%Y", "%d %B %Y", "%Y-13-%d"]
_SPARK_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd", "dd MMM yyyy", "MMMM dd, yyyy", "MMM dd, yyyy", "dd/MM/yyyy", "dd MMMM yyyy", "yyyy-13-dd"]
derived(
    "written_dates",
    "SELECT o_orderkey AS id, o_orderkey % 11 AS kind, o_orderdate AS d, CASE o_orderkey % 11 "
    + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(_FORMATS)) + " END AS written FROM {orders}",
    lambda t: t["orders"].select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 11).alias("kind"),
        F.coalesce(*[F.when(F.col("o_orderkey") % 11 == i, F.date_format("o_orderdate", f.replace("-13-", "'-13-'"))) for i, f in enumerate(_SPARK_FORMATS)]).alias("written"),
    ),
)
PARSED = """
    SELECT id, CASE id % 4 WHEN 1 THEN strptime(date_a, '%d/%m/%Y') WHEN 2 THEN strptime(date_a, '%d.%m.%Y')
      ELSE CAST(date_a AS TIMESTAMP) END::DATE AS date_a, TRY_CAST(date_b AS DATE) AS date_b,
      ticker, len_a, len_b FROM {pair_texts_dated}
"""
query(
    "p13_mixed_dates",
    lambda t: t["pair_texts_dated"].select("id", dates.parse_mixed_date(F.col("date_a")).alias("date_a")),
    f"SELECT id, date_a FROM ({PARSED})",
)
query(
    "p14_coercing_dates",
    lambda t: t["pair_texts_dated"].select("id", dates.parse_iso_date(F.col("date_b")).alias("date_b")),
    f"SELECT id, date_b FROM ({PARSED})",
)
query(
    "p14_coerced_formats",
    lambda t: t["written_dates"].select("id", *[dates.parse_date(F.col("written"), first).alias(name) for name, first in (("month_first", False), ("day_first", True))]),
    """
    SELECT id, CASE kind WHEN 8 THEN CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END WHEN 10 THEN NULL ELSE d END AS month_first,
      CASE kind WHEN 3 THEN CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END WHEN 10 THEN NULL ELSE d END AS day_first
    FROM (SELECT id, kind, CAST(date_trunc('day', d) AS DATE) AS d FROM {written_dates})
    """,
)
query(
    "p13_clean_pairs",
    lambda t: pr.clean_pairs(t["pair_texts_dated"]),
    f"SELECT * FROM ({PARSED}) WHERE len_a >= 75 AND len_b >= 75 AND date_a - date_b < 500",
)
ANCHOR_SQL = """
    SELECT *, CAST(date_trunc('month', date_a) + INTERVAL 1 MONTH AS DATE) AS start_anchor,
      CAST(date_trunc('month', date_a) - INTERVAL 11 MONTH AS DATE) AS prev_start,
      CAST(date_trunc('month', date_a) + INTERVAL 19 MONTH AS DATE) AS end_anchor FROM {pair_rows}
"""
query("p15_month_anchors", lambda t: rt.with_anchors(t["pair_rows"]), ANCHOR_SQL)
query(
    "p16_gross_returns",
    lambda t: rt.monthly_gross(t["firm_returns"]).select(
        "cik", "month", F.round("total", 6).alias("total"), "n", F.round("first_total", 6).alias("first_total"), "first_n"
    ),
    """
    WITH g AS (SELECT cik, date, CASE WHEN isnan(ret) THEN NULL ELSE ret + 1 END AS g FROM {firm_returns})
    SELECT cik, CAST(date_trunc('month', date) AS DATE) AS month, round(sum(g), 6) AS total, count(g) AS n,
      round(sum(g) FILTER (day(date) = 1), 6) AS first_total, count(g) FILTER (day(date) = 1) AS first_n
    FROM g GROUP BY 1, 2
    """,
)
# The range joins as written down, without any of the monthly shortcuts.
derived("anchored_check", ANCHOR_SQL)
derived(
    "windows_check",
    """
    SELECT a.id,
      (avg(ret + 1) FILTER (r.date >= start_anchor AND r.date <= end_anchor) - 1) * 100 AS ret_18,
      (avg(ret + 1) FILTER (r.date >= prev_start AND r.date < start_anchor) - 1) * 100 AS ret_prev_12m
    FROM {anchored_check} a LEFT JOIN (SELECT * FROM {firm_returns} WHERE NOT isnan(ret)) r ON r.cik = a.ticker GROUP BY a.id
    """,
)


def _means(t):
    anchored = rt.with_anchors(t["pair_rows"])
    keyed = anchored.select(F.col("ticker").alias("cik"), "start_anchor")
    means = rt.window_means(keyed, t["firm_returns"]).withColumnRenamed("cik", "ticker")
    return rt.attach(anchored, means, ["ticker", "start_anchor"])


query(
    "j2_forward_mean",
    lambda t: _means(t).select("id", F.round("ret_18", 6).alias("ret_18")),
    "SELECT id, round(ret_18, 6) AS ret_18 FROM {windows_check}",
)
query(
    "j3_backward_mean",
    lambda t: _means(t).select("id", F.round("ret_prev_12m", 6).alias("ret_prev_12m")),
    "SELECT id, round(ret_prev_12m, 6) AS ret_prev_12m FROM {windows_check}",
)
query(
    "a2_window_means",
    lambda t: rt.window_means(
        rt.with_anchors(t["pair_rows"]).select(F.col("ticker").alias("cik"), "start_anchor"), t["firm_returns"]
    ).filter("ret_18 IS NOT NULL OR ret_prev_12m IS NOT NULL").select(
        "cik", "start_anchor", F.round("ret_18", 6).alias("ret_18"), F.round("ret_prev_12m", 6).alias("ret_prev_12m")
    ),
    """
    SELECT DISTINCT ticker AS cik, start_anchor, round(ret_18, 6) AS ret_18, round(ret_prev_12m, 6) AS ret_prev_12m
    FROM {anchored_check} JOIN {windows_check} USING (id) WHERE ret_18 IS NOT NULL OR ret_prev_12m IS NOT NULL
    """,
)
FIRM_SQL = """
    SELECT cik, round(avg(ret + 1) FILTER (NOT isnan(ret)), 9) AS mean_gross_return FROM {firm_returns} GROUP BY cik
"""


def _by_firm(t):
    return rt.mean_return_by_firm(t["firm_returns"]).select(
        "cik", F.round("mean_gross_return", 9).alias("mean_gross_return")
    )


query("a1_mean_by_firm", _by_firm, FIRM_SQL)
query(
    "j4_attach_firm_mean",
    lambda t: rt.attach(t["pair_rows"].withColumnRenamed("ticker", "cik"), _by_firm(t), ["cik"]).select(
        "id", "cik", "mean_gross_return"
    ),
    f"SELECT id, ticker AS cik, mean_gross_return FROM {{pair_rows}} LEFT JOIN ({FIRM_SQL}) f ON f.cik = ticker",
)
query(
    "p17_labelled",
    lambda t: pn.labelled(_means(t)).select("id"),
    "SELECT id FROM {windows_check} WHERE ret_18 IS NOT NULL",
)
derived(
    "panel_check",
    """
    SELECT a.* EXCLUDE (prev_start), ret_18, ret_prev_12m,
      lag(similarity) OVER (PARTITION BY ticker ORDER BY date_a, date_b) AS old_similarity
    FROM {anchored_check} a JOIN {windows_check} USING (id) WHERE ret_18 IS NOT NULL
    """,
)


def _panel(t):
    return pn.build_panel(t["pair_rows"], t["firm_returns"])


query(
    "w3_old_similarity",
    lambda t: pn.with_old_similarity(t["pair_rows"]).select("id", "ticker", "old_similarity"),
    """
    SELECT id, ticker, lag(similarity) OVER (PARTITION BY ticker ORDER BY date_a, date_b) AS old_similarity
    FROM {pair_rows}
    """,
)
query(
    "o2_panel",
    lambda t: pn.sorted_panel(_panel(t)).withColumn("ret_18", F.round("ret_18", 6)).withColumn(
        "ret_prev_12m", F.round("ret_prev_12m", 6)
    ),
    """SELECT * REPLACE (round(ret_18, 6) AS ret_18, round(ret_prev_12m, 6) AS ret_prev_12m),
      row_number() OVER (ORDER BY ticker, date_a, date_b) AS place FROM {panel_check}""",
)

# A ready panel, so that the checks of the features do not repeat those of the joins.
derived(
    "ready_panel",
    """
    SELECT id, ticker, date_a, similarity, len_a, len_b, sentiment,
      CASE WHEN id % 13 = 0 THEN NULL ELSE CAST(id % 991 AS DOUBLE) / 991 END AS old_similarity,
      CASE WHEN id % 17 = 0 THEN NULL ELSE CAST(id * 31 % 10007 AS DOUBLE) / 250 - 20 + similarity END AS ret_18,
      CASE WHEN id % 19 = 0 THEN NULL ELSE CAST(id * 17 % 5003 AS DOUBLE) / 500 - 5 END AS ret_prev_12m
    FROM {pair_rows}
    """,
)
derived("percent_panel", "SELECT id, similarity * 100 AS similarity FROM {pair_rows}")
FEATURES_SQL = """
    SELECT *, CASE WHEN similarity < (SELECT CASE WHEN max(similarity) <= 1.5 THEN 0.70 ELSE 70 END FROM {ready_panel})
        THEN 1 ELSE 0 END AS sim_below_70,
      CASE WHEN sentiment >= 0 THEN 1 ELSE 0 END AS sentiment_pos,
      CASE WHEN len_b <> 0 THEN len_a / len_b - 1 END AS len_growth_pct,
      CASE WHEN len_a > len_b THEN 1 ELSE 0 END AS inc_len, sentiment + old_similarity AS sim_sum
    FROM {ready_panel}
"""


def _features(t):
    return pn.with_features(t["ready_panel"])


query(
    "a3_threshold",
    lambda t: t["percent_panel"].select(
        "id", (F.col("similarity") < pn.low_similarity_threshold(t["percent_panel"])).cast("int").alias("below")
    ),
    """
    SELECT id, CASE WHEN similarity < (SELECT CASE WHEN max(similarity) <= 1.5 THEN 0.70 ELSE 70 END FROM {percent_panel})
      THEN 1 ELSE 0 END AS below FROM {percent_panel}
    """,
)
for key, name in [
    ("f1_sim_below_70", "sim_below_70"),
    ("f2_sentiment_pos", "sentiment_pos"),
    ("f3_len_growth_pct", "len_growth_pct"),
    ("f4_inc_len", "inc_len"),
    ("f5_sim_sum", "sim_sum"),
]:
    query(
        key,
        lambda t, name=name: _features(t).select("id", F.round(name, 9).alias(name)),
        f"SELECT id, round({name}, 9) AS {name} FROM ({FEATURES_SQL})",
    )
for key, names in [
    ("f6_complete_cases", models.REGRESSION_FEATURES),
    ("f6_complete_cases_classification", models.CLASSIFICATION_FEATURES),
]:
    query(
        key,
        lambda t, names=names: pn.complete_cases(_features(t), [*names, "ret_18"]).select("id", "ret_18"),
        f"SELECT id, ret_18 FROM ({FEATURES_SQL}) WHERE "
        + " AND ".join(f"{n} IS NOT NULL" for n in [*names, "ret_18"]),
    )
EDGES_SQL = "SELECT quantile_cont(ret_18, [0.2, 0.4, 0.6, 0.8]) AS e FROM {ready_panel}"
CLASS_SQL = f"""
    SELECT id, ret_18, CASE WHEN ret_18 IS NOT NULL THEN (ret_18 > e[1])::INT + (ret_18 > e[2])::INT + (ret_18 > e[3])::INT
      + (ret_18 > e[4])::INT END AS ret_18_class FROM {{ready_panel}}, ({EDGES_SQL})
"""
query(
    "a4_quintiles",
    lambda t: qt.with_quintiles(t["ready_panel"]).select("id", "ret_18_class", "ret_18_bucket"),
    f"""
    SELECT id, ret_18_class, (['very_negative', 'negative', 'flat', 'positive', 'very_positive'])[ret_18_class + 1]
      AS ret_18_bucket FROM ({CLASS_SQL})
    """,
)
query(
    "a8_histogram",
    lambda t: qt.histogram(t["ready_panel"], "ret_18").select(
        "bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n"
    ),
    """
    WITH b AS (SELECT min(ret_18) AS lo, (max(ret_18) - min(ret_18)) / 1000 AS w FROM {ready_panel}),
    c AS (SELECT least(CAST(floor((ret_18 - lo) / w) AS BIGINT), 999) AS bin, count(*) AS n
      FROM {ready_panel}, b WHERE ret_18 IS NOT NULL GROUP BY 1)
    SELECT r.bin, round(lo + r.bin * w, 6) AS lower, round(lo + (r.bin + 1) * w, 6) AS upper, coalesce(n, 0) AS n
    FROM (SELECT unnest(range(0, 1000)) AS bin) r CROSS JOIN b LEFT JOIN c ON c.bin = r.bin
    """,
)
