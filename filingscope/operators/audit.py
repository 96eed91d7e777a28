"""Coverage and ingest audits."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from filingscope.functions.dates import accession_year, normalise_cik


def covered_years(similarity: DataFrame) -> DataFrame:
    """Years each firm's similarity rows speak for: all of date_a, and date_b of the oldest row."""
    cik = normalise_cik(F.col("ticker")).alias("cik")
    newer = similarity.select(cik, F.year("date_a").alias("year"))
    oldest = similarity.groupBy(cik).agg(
        F.year(F.min_by("date_b", F.struct("date_a", "date_b"))).alias("year")
    )
    return newer.union(oldest).distinct()


def coverage_gaps(filings: DataFrame, similarity: DataFrame) -> DataFrame:
    """One (cik, year) row per filing whose accession year is not covered."""
    landed = filings.select(
        normalise_cik(F.col("cik")).alias("cik"), accession_year(F.col("accession")).alias("year")
    )
    return landed.filter(F.col("year").isNotNull()).join(covered_years(similarity), ["cik", "year"], "left_anti")


def landed_filers(filers: DataFrame, landed: DataFrame) -> DataFrame:
    """Filers with at least one landed filing."""
    return filers.join(landed.select("cik"), "cik", "left_semi")


def ingest_status(filers: DataFrame, landed: DataFrame, errors: DataFrame) -> DataFrame:
    """Per expected filer: error, not_found or ok."""
    found = landed.groupBy("cik").agg(F.lit(True).alias("_found"))
    failed = errors.groupBy("cik").agg(F.lit(True).alias("_failed"))
    status = (
        F.when(F.col("_failed"), "error").when(F.col("_found"), "ok").otherwise("not_found").alias("status")
    )
    return filers.join(found, "cik", "left").join(failed, "cik", "left").select("cik", status)


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("n"))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count the rows that pass `df` while the next action runs, without a pass of its own."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch


def step_counts(rows: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """How many rows are read and how many pass each step, counted while the steps run: step, rows.

    The rows are read once and nothing is counted in a pass of its own. A step that reads its input more than once should store it.
    """
    spark = rows.sparkSession
    df, watch = observed(rows, f"read-{uuid.uuid4().hex}")
    watches = [("read", watch)]
    for name, step in steps:
        df, watch = observed(step(df), f"{name}-{uuid.uuid4().hex}")
        watches.append((name, watch))
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(name, watch.get["rows"]) for name, watch in watches], "step STRING, rows BIGINT")
