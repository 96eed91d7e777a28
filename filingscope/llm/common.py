"""What the operators of this subpackage share.

Every operator selects the columns it needs by name, so further columns of its input never clash with its own.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from filingscope.session import work_folder

# Rows of one Arrow batch: texts are some KB in general and some MB at worst.
BATCH_ROWS = 512

# Bytes that end a word; bytes.split() without arguments splits at exactly these.
WORD_SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each context: workers need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_filingscope_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / "filingscope_modules.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(package.rglob("*.py")):
            packed.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._filingscope_shipped = True


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """`mapInArrow` in batches whose size is bounded for texts."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def shared(spark: SparkSession, value: object) -> Broadcast:
    """Send a value of proven size to all workers once."""
    return spark.sparkContext.broadcast(value)


def saved(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs neither recompute it nor need its executors.

    It is deleted when the driver ends.
    """
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._filingscope_path = path
    return table


def erased(*tables: DataFrame) -> None:
    """Delete the files of saved tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        if (place := getattr(table, "_filingscope_path", None)) is not None:
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """`saved`, and the shuffles it took are removed, not kept until the driver next collects garbage."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        return saved(df)
    finally:
        spark.conf.set(name, before)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Helper names that no column of `df` has, whatever its letter case."""
    taken = {name.lower() for name in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text modulo `parts`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def text_key() -> list[Column]:
    """128 bits of the text's content; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2")]


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which remainders of a long column modulo 2 ** bits occur: 2 ** (bits - 3) bytes, however many rows there are."""
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    table = df.groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    cells = np.zeros(1 << (bits - 6), np.int64)
    cells[table.column("cell").to_numpy()] = table.column("bits").to_numpy()
    return cells.view(np.uint64)


def in_bitmap(cells: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be in the column of the bitmap; if not, it surely is not."""
    values = values.view(np.uint64)
    place = values & np.uint64(64 * len(cells) - 1)
    return (cells[place >> np.uint64(6)] >> (values & np.uint64(63)) & np.uint64(1)).astype(bool)
