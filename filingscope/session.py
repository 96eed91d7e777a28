"""Session settings every job of this package expects."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Python holds a batch of texts several times over, in each worker of an executor.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the SQL options above on a session that somebody else created."""
    for key, value in SESSION_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return folder.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """A new folder below the one all executors can reach, for a table that lasts as long as the driver.

    A local session without spark.checkpoint.dir uses its warehouse folder. Everything a driver has put there is deleted when it ends.
    """
    context = spark.sparkContext
    base = getattr(context, "_filingscope_work", None)
    if base is None:
        local = context.master.startswith("local") and not context.master.startswith("local-cluster")
        root = spark.conf.get("spark.sql.warehouse.dir") if local and not spark.conf.get("spark.checkpoint.dir", None) else shared_folder(spark)
        base = f"{root.rstrip('/')}/filingscope-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(base)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._filingscope_work = base
    return f"{base}/{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("filingscope")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
