"""Stock returns per filer, and mean returns around a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingscope.functions.dates import normalise_cik, start_anchor

FORWARD_MONTHS = 18
BACK_MONTHS = 12
# Link types and priorities that tie a security to a filer.
LINK_TYPES = ("LU", "LC")
LINK_PRIORITIES = ("P", "C")
# The study's own period, for callers that want it.
STUDY_FIRST_DATE = "2006-01-01"
STUDY_LAST_DATE = "2025-10-31"


def link_returns(
    stock: DataFrame,
    links: DataFrame,
    companies: DataFrame,
    filers: DataFrame | None = None,
    first: str | None = None,
    last: str | None = None,
) -> DataFrame:
    """Returns of each filer while its link to the security was valid, from `first` to `last` if given.

    Overlapping links yield one row each. The two small tables are joined first; Spark broadcasts
    the result if its measured size allows and splits skewed securities otherwise.
    """
    companies = companies.withColumn("cik", normalise_cik(F.col("cik")))
    if filers is not None:
        companies = companies.join(
            filers.select(normalise_cik(F.col("cik")).alias("cik")), "cik", "left_semi"
        )
    valid = links.filter(F.col("linktype").isin(*LINK_TYPES) & F.col("linkprim").isin(*LINK_PRIORITIES))
    linked = valid.join(companies, "gvkey").select(
        "lpermno", "linkdt", "linkenddt", "cik", F.col("conm").alias("company_name")
    )
    inside = (F.col("date") >= F.col("linkdt")) & (
        (F.col("date") <= F.col("linkenddt")) | F.col("linkenddt").isNull()
    )
    if first is not None:
        stock = stock.filter(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        stock = stock.filter(F.col("date") <= F.lit(last).cast("date"))
    return stock.join(linked, (F.col("permno") == F.col("lpermno")) & inside).select(
        "cik", "company_name", "date", "ret"
    )


def _gross(ret: Column) -> Column:
    """1 + return, NULL for a missing one."""
    return F.nanvl(ret, F.lit(None).cast("double")) + 1


def _percent(mean: Column) -> Column:
    return (mean - 1) * 100


def _month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def with_anchors(pairs: DataFrame) -> DataFrame:
    """Add the month after the newer filing, one year before it and 18 months after it."""
    anchored = pairs.withColumn("start_anchor", start_anchor(F.col("date_a")))
    return anchored.withColumn("prev_start", F.add_months("start_anchor", -BACK_MONTHS)).withColumn(
        "end_anchor", F.add_months("start_anchor", FORWARD_MONTHS)
    )


def monthly_gross(returns: DataFrame) -> DataFrame:
    """Sum and count of gross returns per filer and month, and of the month's first day alone.

    The result has at most one row per filer and calendar month, however many returns there are.
    """
    gross = _gross(F.col("ret"))
    first_day = F.when(F.col("date") == F.trunc("date", "MM"), gross)
    return returns.groupBy("cik", F.trunc("date", "MM").alias("month")).agg(
        F.sum(gross).alias("total"),
        F.count(gross).alias("n"),
        F.sum(first_day).alias("first_total"),
        F.count(first_day).alias("first_n"),
    )


def window_means(
    anchors: DataFrame,
    returns: DataFrame,
    forward_months: int = FORWARD_MONTHS,
    back_months: int = BACK_MONTHS,
) -> DataFrame:
    """Mean percent returns after and before each (cik, start_anchor) with any return in its windows.

    Forward covers start <= date <= start + forward_months, backward
    start - back_months <= date < start. Anchors are first days, so the windows consist of whole
    months plus, at the closed forward end, one first day. Monthly sums and anchors of a filer are laid on one
    line of months; ranges over it give all windows after a single shuffle. A filer has at most two rows a month
    there, so none can overload a task.
    """
    sums = monthly_gross(returns).withColumn("m", _month_number(F.col("month"))).withColumn("has", F.lit(1))
    asked = anchors.select("cik", "start_anchor").distinct().withColumn("m", _month_number(F.col("start_anchor")))
    line = sums.unionByName(asked, allowMissingColumns=True).filter(F.col("cik").isNotNull())
    by_month = W.partitionBy("cik").orderBy("m")

    def total(column: str, first: int, last: int) -> Column:
        return F.sum(column).over(by_month.rangeBetween(first, last))

    def forward(inner: str, closing: str) -> Column:
        parts = (total(inner, 0, forward_months - 1), total(closing, forward_months, forward_months))
        return sum((F.coalesce(part, F.lit(0)) for part in parts), F.lit(0))

    return (
        line.withColumns(
            {
                "forward_total": forward("total", "first_total"),
                "forward_n": forward("n", "first_n"),
                "back_total": F.coalesce(total("total", -back_months, -1), F.lit(0)),
                "back_n": F.coalesce(total("n", -back_months, -1), F.lit(0)),
                "months": total("has", -back_months, forward_months),
            }
        )
        .filter(F.col("start_anchor").isNotNull() & (F.col("months") > 0))
        .select(
            "cik",
            "start_anchor",
            _percent(F.try_divide("forward_total", "forward_n")).alias("ret_18"),
            _percent(F.try_divide("back_total", "back_n")).alias("ret_prev_12m"),
        )
    )


def mean_return_by_firm(returns: DataFrame) -> DataFrame:
    return returns.groupBy("cik").agg(F.avg(_gross(F.col("ret"))).alias("mean_gross_return"))


def attach(rows: DataFrame, aggregate: DataFrame, keys: list[str]) -> DataFrame:
    """Look an aggregate up for every row; rows without one get NULLs."""
    return rows.join(aggregate, keys, "left")
