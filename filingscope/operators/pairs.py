"""Consecutive filing pairs and the filters on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.functions.dates import parse_mixed_date
from filingscope.functions.ordered import with_previous, with_rank

MIN_TOKENS = 75
MAX_GAP_DAYS = 500


def newest_first(filings: DataFrame) -> DataFrame:
    """Filings with an ISO date text and their place from 1, newest first; same-day filings by accession, the last one first."""
    dated = filings.select("cik", "accession", F.date_format("filed_date", "yyyy-MM-dd").alias("filed"))
    return with_rank(dated, [F.desc("filed"), F.desc("accession"), F.desc("cik")], into="place")


def with_section(filings: DataFrame, sections: DataFrame, item: str = "1A") -> DataFrame:
    """Only the filings that have the given item."""
    having = sections.filter(F.col("item_n") == item).select("cik", "accession")
    return filings.join(having, ["cik", "accession"], "left_semi")


def consecutive_pairs(filings: DataFrame) -> DataFrame:
    """Each filing (a, newer) with the one before it (b, older) of the same firm.

    Runs on keys and dates only. A firm's filings are windowed month by month, so one firm with a
    large share of all filings does not end up in one task.
    """
    keyed = filings.select("cik", "accession", "filed_date")
    linked = with_previous(
        keyed,
        keys=["cik"],
        order=["filed_date", "accession"],
        values=["accession", "filed_date"],
        chunk=F.trunc("filed_date", "MM"),
        into="older",
    )
    return linked.filter(F.col("older").isNotNull()).select(
        "cik",
        F.col("accession").alias("filing_a"),
        F.col("filed_date").alias("date_a"),
        F.col("older.accession").alias("filing_b"),
        F.col("older.filed_date").alias("date_b"),
    )


def long_enough(rows: DataFrame, minimum: int = MIN_TOKENS) -> DataFrame:
    return rows.filter((F.col("len_a") >= minimum) & (F.col("len_b") >= minimum))


def close_enough(rows: DataFrame, days: int = MAX_GAP_DAYS) -> DataFrame:
    """Pairs less than `days` apart; a negative gap passes."""
    return rows.filter(F.datediff("date_a", "date_b") < days)


def clean_pairs(rows: DataFrame) -> DataFrame:
    """Length filter, day-first dates where they are still text, gap filter."""
    rows = long_enough(rows)
    for name in ("date_a", "date_b"):
        if dict(rows.dtypes)[name] == "string":
            rows = rows.withColumn(name, parse_mixed_date(F.col(name)))
    return close_enough(rows)
