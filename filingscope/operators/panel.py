"""The panel of pairs and returns, and the model features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.functions.ordered import with_previous, with_rank
from filingscope.operators.returns import attach, window_means, with_anchors

# The thresholds below which a similarity counts as low, in either unit.
LOW_SIMILARITY = 0.70
LOW_SIMILARITY_PERCENT = 70.0
LARGEST_FRACTION = 1.5


def labelled(rows: DataFrame) -> DataFrame:
    return rows.na.drop(subset=["ret_18"])


def with_old_similarity(rows: DataFrame) -> DataFrame:
    """Add the similarity of the firm's preceding row, by (date_a, date_b).

    Run it after rows without a label are gone: the offset counts the rows that are left.
    """
    return (
        with_previous(
            rows,
            keys=["ticker"],
            order=["date_a", "date_b"],
            values=["similarity"],
            chunk=F.trunc("date_a", "MM"),
            into="_older",
        )
        .withColumn("old_similarity", F.col("_older.similarity"))
        .drop("_older")
    )


def sorted_panel(rows: DataFrame) -> DataFrame:
    """The panel with each row's place from 1 by firm and date of the newer filing, then of the older one."""
    return with_rank(rows, [F.asc("ticker"), F.asc("date_a"), F.asc("date_b")], into="place")


def build_panel(similarity: DataFrame, returns: DataFrame) -> DataFrame:
    """Similarity rows with mean returns after and before the filing and the preceding similarity."""
    anchored = with_anchors(similarity)
    keyed = anchored.select(F.col("ticker").alias("cik"), "start_anchor")
    means = window_means(keyed, returns).withColumnRenamed("cik", "ticker")
    rows = attach(anchored, means, ["ticker", "start_anchor"]).drop("prev_start")
    return with_old_similarity(labelled(rows))


def finite(value: Column) -> Column:
    """NULL for NaN and the infinities."""
    infinite = value.isin(float("inf"), float("-inf"))
    return F.when(~F.isnan(value) & ~infinite, value)


def low_similarity_threshold(rows: DataFrame) -> Column:
    """0.70 or 70, whichever unit the largest finite similarity shows, as a scalar subquery."""
    top = F.max(finite(F.col("similarity")))
    limit = F.when(top <= LARGEST_FRACTION, LOW_SIMILARITY).otherwise(LOW_SIMILARITY_PERCENT)
    return rows.agg(limit.alias("threshold")).scalar()


def with_features(rows: DataFrame) -> DataFrame:
    """Add the derived model features; `rows` is a panel."""
    below = F.col("similarity") < low_similarity_threshold(rows)
    positive = (F.col("sentiment") >= 0) & ~F.isnan("sentiment")
    return (
        rows.withColumn("sim_below_70", F.coalesce(below, F.lit(False)).cast("int"))
        .withColumn("sentiment_pos", F.coalesce(positive, F.lit(False)).cast("int"))
        .withColumn("len_growth_pct", F.try_divide("len_a", "len_b") - 1)
        .withColumn("inc_len", F.coalesce(F.col("len_a") > F.col("len_b"), F.lit(False)).cast("int"))
        .withColumn("sim_sum", F.col("sentiment") + F.col("old_similarity"))
    )


def complete_cases(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.na.drop(subset=columns)
