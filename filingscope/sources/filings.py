"""Landed filings: one text file per filing under <cik>/<form>/<accession>/."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingscope.functions.dates import accession_year, normalise_cik
from filingscope.functions.ordered import latest_per_key, stored

# Ship the writer with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREE_KEYS = r"([^/]+)/([^/]+)/([^/]+)/[^/]+$"
# The study's first filing date and year, and filings kept per filer.
START_DATE = "2006-01-01"
FIRST_YEAR = 2006
LATEST_FILINGS = 20
# Fixed value: the file name of a landed submission.
SUBMISSION = "full-submission.txt"
# Bytes of filings that one task reads, and that it holds at once beside its largest filing.
TASK_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
# Signs of a path that its URI holds as they are.
PATH_SIGNS = "/-_.!~*'(),;:$&+=@"


def with_tree_keys(files: DataFrame, path: str = "path") -> DataFrame:
    """Add cik, form and accession from the last directories of a path."""

    def part(i: int) -> Column:
        return F.regexp_extract(F.col(path), TREE_KEYS, i)

    return files.withColumns({"cik": normalise_cik(part(1)), "form": part(2), "accession": part(3)})


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    marked = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return marked and not name.startswith(("_metadata", "_common_metadata"))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder, given as root and a path below it."""
    for batch in batches:
        for root, place in zip(*(column.to_pylist() for column in batch.columns)):
            store, base = FileSystem.from_uri(root)
            inside = [e for e in store.get_file_info(FileSelector(base.rstrip("/") + place)) if not _hidden(e.base_name)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([root] * len(inside), pa.string()),
                    pa.array([f"{place}/{e.base_name}" for e in inside], pa.string()),
                    pa.array([e.type == FileType.Directory for e in inside], pa.bool_()),
                    pa.array([e.size or 0 for e in inside], pa.int64()),
                ],
                ["root", "place", "folder", "bytes"],
            )


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path and whole content of each file; a batch ends with the file that fills it."""

    def packed(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        paths, bodies = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], ["path", "value"])

    rows, held = [], 0
    for batch in batches:
        for root, place in zip(*(column.to_pylist() for column in batch.columns)):
            store, base = FileSystem.from_uri(root)
            with store.open_input_stream(base.rstrip("/") + place) as file:
                rows.append((_uri(root, place), file.read()))
            held += len(rows[-1][1])
            if held >= BATCH_BYTES:
                yield packed(rows)
                rows, held = [], 0
    if rows:
        yield packed(rows)


def _uri(root: str, place: str) -> str:
    """A file's path as Spark names it."""
    signs = (c if c.isalnum() or ord(c) > 127 or c in PATH_SIGNS else f"%{ord(c):02X}" for c in place)
    return root.rstrip("/").replace("file:///", "file:/", 1) + "".join(signs)


def _roots(spark: SparkSession, paths: list[str]) -> list[str] | None:
    """The folders' URIs, or None unless all are folders of a store that the tasks can list."""
    conf, roots = spark.sparkContext._jsc.hadoopConfiguration(), []
    for text in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
        files = path.getFileSystem(conf)
        if not files.exists(path) or not files.getFileStatus(path).isDirectory():
            return None
        roots.append(files.makeQualified(path).toUri().toString())
        try:
            FileSystem.from_uri(roots[-1])
        except (pa.ArrowException, OSError):
            return None
    # A folder below another one adds nothing.
    return [b for b in roots if not any(a != b and b.startswith(a.rstrip("/") + "/") for a in roots)]


def _listed(spark: SparkSession, roots: list[str], file_name: str) -> DataFrame:
    """root, place and bytes of every file below the roots whose name matches: tasks list a level of the tree at a time."""
    cores = spark.sparkContext.defaultParallelism
    level, files = spark.createDataFrame([(root, "") for root in dict.fromkeys(roots)], "root STRING, place STRING"), []
    while not level.isEmpty():
        found = stored(level.repartition(4 * cores).mapInArrow(_entries, "root STRING, place STRING, folder BOOLEAN, bytes LONG"))
        files.append(found.filter("NOT folder AND bytes > 0").drop("folder"))
        level = found.filter("folder").select("root", "place")
    name = F.substring_index("place", "/", -1)
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern.compile(file_name).pattern()
    return reduce(DataFrame.union, files).filter(F.rlike(name, F.lit(rf"\A(?:{pattern})\z")) & ~F.startswith(name, F.lit("_metadata")))


def read_filings(spark: SparkSession, paths: str | list[str], file_name: str = SUBMISSION) -> DataFrame:
    """Every landed filing below the paths as one row; an empty file is none.

    The tree may also hold split items and cleaned copies under other file names. Tasks list it and read it, so the driver never holds
    the names of its files. Paths with wildcards, single files and stores that only Spark reads go through Spark's own listing on the driver.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    roots = _roots(spark, paths)
    if roots is None:
        files = (
            spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", file_name)
            .text(paths, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
        )
    else:
        listed = _listed(spark, roots, file_name)
        size = listed.agg(F.sum("bytes").alias("n")).first()["n"] or 0
        tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
        read = listed.select("root", "place").repartition(tasks).mapInArrow(_bodies, "path STRING NOT NULL, value BINARY")
        files = read.select("path", F.col("value").cast("string").alias("body"))
    return with_tree_keys(files).select("cik", "form", "accession", "path", "body")


def write_filings(filings: DataFrame, root: str, form: str = "10-K", file_name: str = SUBMISSION) -> DataFrame:
    """Land each filing as <root>/<cik>/<form>/<accession>/<file_name>, written by the tasks: the paths, once written.

    A file is written under a name of its own and then moved, so a task that is run again leaves whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(root)
        for batch in batches:
            paths = []
            for cik, accession, body in zip(*(column.to_pylist() for column in batch.columns)):
                folder = f"{base.rstrip('/')}/{cik}/{form}/{accession}"
                store.create_dir(folder, recursive=True)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write((body or "").encode())
                store.move(part, f"{folder}/{file_name}")
                paths.append(f"{folder}/{file_name}")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return stored(filings.select("cik", "accession", "body").mapInArrow(run, "path STRING"))


def from_year(filings: DataFrame, first: int = FIRST_YEAR) -> DataFrame:
    """Filings whose accession year is `first` or later."""
    return filings.filter(accession_year(F.col("accession")) >= first)


def bad_accessions(filings: DataFrame) -> DataFrame:
    """Rows whose accession has no year to read."""
    return filings.filter(accession_year(F.col("accession")).isNull()).select(
        "cik", "accession", F.lit("bad_accession").alias("reason")
    )


def landing_rejects(filings: DataFrame, first: int = FIRST_YEAR) -> DataFrame:
    """Filings that `usable_filings` leaves out, with the reason: cik, accession, reason."""
    year = accession_year(F.col("accession"))
    reason = F.when(year.isNull(), "bad_accession").when(year < first, "before_first_year")
    keyed = filings.select("cik", "accession", reason.alias("reason"))
    repeated = keyed.filter(F.col("reason").isNull()).groupBy("cik", "accession").agg(F.count("*").alias("n"))
    more = repeated.filter("n > 1").select(
        "cik", "accession", F.explode(F.array_repeat(F.lit("duplicate_filing"), (F.col("n") - 1).cast("int"))).alias("reason")
    )
    return keyed.filter(F.col("reason").isNotNull()).unionByName(more)


def usable_filings(filings: DataFrame, first: int = FIRST_YEAR) -> DataFrame:
    """Filings from year `first` on, one for each (cik, accession): later stages rely on unique keys.

    Of several the one with the smallest path, or body where there is no path, stays.
    """
    kept = from_year(filings, first)
    order = "path" if "path" in filings.columns else "body"
    place = F.row_number().over(W.partitionBy("cik", "accession").orderBy(order))
    return kept.withColumn("_place", place).filter("_place = 1").drop("_place")


def filed_from(filings: DataFrame, start: str = START_DATE) -> DataFrame:
    return filings.filter(F.col("filed_date") >= F.lit(start).cast("date"))


def latest_filings(filings: DataFrame, n: int = LATEST_FILINGS) -> DataFrame:
    """The newest `n` filings of each filer."""
    return latest_per_key(filings, ["cik"], [F.desc("filed_date"), F.desc("accession")], n)
