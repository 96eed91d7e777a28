"""Typed CSV and Parquet tables, and the sinks of each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingscope.functions.dates import normalise_cik

KEY_COLUMNS = ("cik", "ticker")


def _normalised(df: DataFrame) -> DataFrame:
    """Padded keys, and NULL instead of NaN."""
    for name, kind in df.dtypes:
        if name in KEY_COLUMNS:
            df = df.withColumn(name, normalise_cik(F.col(name)))
        elif kind in ("double", "float"):
            df = df.withColumn(name, F.nanvl(F.col(name), F.lit(None).cast(kind)))
    return df


def typed(rows: DataFrame, schema: str, rejected: bool = False) -> DataFrame:
    """Text columns selected by name and cast to a declared schema; further columns are left out.

    A column that the rows lack is NULL. With `rejected`, a column `_bad` names the first column whose text does not
    fit its type.
    """
    fields = T.StructType.fromDDL(schema).fields
    known = {name.lower(): name for name in rows.columns}
    out, bad = [], []
    for field in fields:
        source = known.get(field.name.lower())
        if source is None:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        text = F.nullif(F.trim(F.col(f"`{source}`")), F.lit(""))
        value = text if field.dataType == T.StringType() else text.try_cast(field.dataType)
        out.append(value.alias(field.name))
        bad.append(F.when(text.isNotNull() & value.isNull(), F.lit(field.name)))
    if rejected:
        out.append((F.coalesce(*bad) if bad else F.lit(None).cast("string")).alias("_bad"))
    return _normalised(rows.select(*out))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, its columns matched by name; lines with a value that does not fit are left out."""
    return typed(_csv_text(spark, path), schema, rejected=True).filter(F.col("_bad").isNull()).drop("_bad")


def csv_rejects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that `read_csv` leaves out, with the column that does not fit: what could be read, _bad."""
    return typed(_csv_text(spark, path), schema, rejected=True).filter(F.col("_bad").isNotNull())


def _csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text under its own header name; files whose headers differ in order are an error, not a mix-up."""
    return spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)


def parse_csv(rows: DataFrame, column: str, schema: str, header: str | None = None) -> DataFrame:
    """CSV lines held in a column, by position as `schema` says, or by name as a header line says."""
    if header is None:
        return _normalised(rows.select(F.from_csv(F.col(column), schema).alias("r")).select("r.*"))
    names = [name.strip() or f"_unnamed{i}" for i, name in enumerate(header.split(","))]
    text = ", ".join(f"`{name}` STRING" for name in names)
    return typed(rows.select(F.from_csv(F.col(column), text).alias("r")).select("r.*"), schema)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _normalised(spark.read.parquet(path))


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_sections(sections: DataFrame, path: str) -> None:
    """One directory per item label, so a reader of one item reads only that."""
    write_parquet(sections, path, partition_by="item_n")
