"""The query register and the derived input tables.

A derived table is one SELECT that Spark and DuckDB both understand, with the tables it reads in braces.
Spark runs it as a DataFrame, the checking SQL as a common table expression. Where the two dialects
differ, the table has a DataFrame builder for Spark and its own SELECT for DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from filingscope.functions.ordered import spread
from filingscope.functions.text import SPACE_CLASS, S
from filingscope.operators.html_text import RUN

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

# Tables whose rows, or the texts derived from them, cost far more to process than to read.
TEXT_TABLES = ("documents", "pages", "conversations", "orders")

NAMES = re.compile(r"\{([a-z]\w*)\}")


@dataclass
class Inputs:
    """Base and derived tables of one scale folder, read lazily."""

    spark: SparkSession
    folder: str
    cache: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.cache:
            self.cache[name] = self._load(name)
        return self.cache[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(table) if name in TEXT_TABLES else table
        if name in SPARK_BUILDERS:
            return SPARK_BUILDERS[name](self)
        text = DERIVED[name]
        return self.spark.sql(text, **{n: self[n] for n in set(NAMES.findall(text))})


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


DERIVED: dict[str, str] = {}
SPARK_BUILDERS: dict[str, Callable[[Inputs], DataFrame]] = {}
QUERIES: dict[str, Query] = {}


def derived(name: str, sql: str, spark: Callable[[Inputs], DataFrame] | None = None) -> None:
    """Declare a derived table. Names ending in `_check` are steps of a checking SQL, unused by Spark."""
    DERIVED[name] = sql
    if spark is not None:
        SPARK_BUILDERS[name] = spark


def _ordered_names(text: str, seen: list[str]) -> list[str]:
    for name in NAMES.findall(text):
        if name in DERIVED and name not in seen:
            _ordered_names(DERIVED[name], seen)
            seen.append(name)
    return seen


def with_tables(sql: str) -> str:
    """Prefix a SELECT with the derived tables it names in braces."""
    names = _ordered_names(sql, [])
    parts = [
        f"{name} AS {'MATERIALIZED ' if name.endswith('_check') else ''}({NAMES.sub(lambda m: m.group(1), DERIVED[name])})"
        for name in names
    ]
    body = NAMES.sub(lambda m: m.group(1), sql)
    if not parts:
        return body
    stripped = body.lstrip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if stripped.startswith(head):
            return head + ", ".join(parts) + ", " + stripped[len(head) :]
    return "WITH " + ", ".join(parts) + " " + body


def query(key: str, build: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
    """Register a query; without `sql` it is checked by the tests only."""
    if key in QUERIES:
        raise ValueError(f"duplicate query {key}")
    QUERIES[key] = Query(
        lambda spark, folder: build(Inputs(spark, folder)), with_tables(sql) if sql is not None else None
    )


def re2(pattern: str) -> str:
    """A regex of this package as an SQL literal for an engine without lookaround."""
    pattern = pattern.replace("(?iu:", "(?i:").replace(RUN, S + "+").replace("*+", "*").replace(S, f"[{SPACE_CLASS}]")
    pattern = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)
    return "'" + pattern.replace("'", "''") + "'"
