"""Quarterly filing indexes: pipe-separated text files behind a free-form header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.functions.dates import normalise_cik, parse_iso_date
from filingscope.functions.ordered import with_previous, with_rank
from filingscope.functions.text import let, lines

# Fixed values.
HEADER_START = "CIK|"
FIELDS = ("cik", "company_name", "form_type", "date_filed", "filename")
KEEP_FORMS = ("10-K", "10KSB", "10-KT")
FORM_PREFIX = "10-K"
# Rows of one file that are deduplicated together.
DEDUPE_CHUNK = 65_536


def read_index_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All index files in one read: source_file and the whole body."""
    files = spark.read.text(paths, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("body"))


def _after_header(all_lines: Column) -> Column:
    """The numbered lines below the first header line; none if there is no header."""

    def cut(parts: Column) -> Column:
        numbered = F.transform(parts, lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))
        header = F.array_position(F.transform(parts, lambda l: F.startswith(l, F.lit(HEADER_START))), True)
        # Bound once: inside the filter it would look for the header again at every line.
        return let(header, lambda at: F.when(at > 0, F.filter(numbered, lambda r: r["line_no"] > at)))

    return let(all_lines, cut)


def _any_data_line(all_lines: Column) -> Column:
    numbered = F.transform(all_lines, lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))
    return F.filter(numbered, lambda r: ~F.startswith(r["line"], F.lit(HEADER_START)))


def index_lines(files: DataFrame, strict: bool = True) -> DataFrame:
    """Candidate lines with their fields: source_file, line_no, fields.

    Strict parsing starts below the header; lenient parsing takes every line with a separator that
    is no header.
    """
    parts = lines(F.col("body"))
    chosen = _after_header(parts) if strict else _any_data_line(parts)
    return (
        files.select("source_file", F.explode(chosen).alias("r"))
        .filter(F.contains("r.line", F.lit("|")))
        .select("source_file", "r.line_no", "r.line", F.split("r.line", r"[|]").alias("fields"))
    )


def parse_index(files: DataFrame, strict: bool = True) -> DataFrame:
    """Index rows: source_file, line_no and the five fields as strings."""
    good = index_lines(files, strict).filter(F.size("fields") == len(FIELDS))
    return good.select(
        "source_file", "line_no", *[F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(FIELDS)]
    )


def index_rejects(files: DataFrame, strict: bool = True) -> DataFrame:
    """Lines with a separator but the wrong number of fields."""
    return (
        index_lines(files, strict)
        .filter(F.size("fields") != len(FIELDS))
        .select("source_file", "line_no", "line", F.lit("field_count").alias("reason"))
    )


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All rows of several frames; a column one of them lacks is NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def keep_forms(rows: DataFrame, forms: tuple[str, ...] = KEEP_FORMS) -> DataFrame:
    return rows.filter(F.col("form_type").isin(*forms))


def form_prefix(rows: DataFrame, prefix: str = FORM_PREFIX) -> DataFrame:
    return rows.filter(F.startswith("form_type", F.lit(prefix)))


def filed_between(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Rows filed from `first` to `last`, both inclusive."""
    filed = parse_iso_date(F.col("date_filed"))
    return rows.filter(filed.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def name_prefix(rows: DataFrame, prefix: str = "A") -> DataFrame:
    return rows.filter(F.startswith(F.upper(F.trim("company_name")), F.lit(prefix)))


def filing_urls(rows: DataFrame, base: str) -> DataFrame:
    return rows.select(F.concat(F.lit(base), F.col("filename")).alias("url"))


def first_of_each_block(rows: DataFrame) -> DataFrame:
    """Keep a row unless the row just before it, in file and line order, has the same cik.

    Files are windowed chunk by chunk. Across files one row per file is needed, its last cik: files are numbered in order by
    ranges, and each takes its carry from the file with the number before, so no task sees all files.
    """
    linked = with_previous(
        rows,
        keys=["source_file"],
        order=["line_no"],
        values=["cik"],
        chunk=F.floor(F.col("line_no") / DEDUPE_CHUNK),
        into="_previous",
    )
    last = rows.groupBy("source_file").agg(F.max_by(F.struct("cik"), "line_no").alias("_last"))
    files = with_rank(last, [F.col("source_file")], into="_file")
    ahead = files.select((F.col("_file") + 1).alias("_file"), F.col("_last").alias("_carried"))
    carried = files.select("source_file", "_file").join(ahead, "_file").select("source_file", "_carried")
    before = F.coalesce("_previous", "_carried")
    return (
        linked.join(carried, "source_file", "left")
        .filter(before.isNull() | ~before["cik"].eqNullSafe(F.col("cik")))
        .drop("_previous", "_carried")
    )


def filer_list(table: DataFrame, column: str = "CIK") -> DataFrame:
    """The filer keys of a table, trimmed and padded."""
    return table.select(normalise_cik(F.col(column)).alias("cik"))


def only_filers(rows: DataFrame, ciks: list[str] | DataFrame | None = None) -> DataFrame:
    """All rows, or those of the given filers: a short list, or a table of any size."""
    if ciks is None:
        return rows
    if isinstance(ciks, DataFrame):
        return rows.join(filer_list(ciks, "cik"), "cik", "left_semi")
    return rows.filter(F.col("cik").isin(*[c.strip().zfill(10) for c in ciks]))
