"""Lineage cuts: tables written to the shared folder that the cluster names.

An executor can be lost at any time, so intermediate results live in
``spark.checkpoint.dir`` (read from the session), never in executor memory or
in a machine's own temporary folder.  Where the setting is absent and all runs
on one machine, as in tests, a folder is chosen here; on a cluster it has to be set.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="regionframe-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of some numbers that make up a file, where a table's size is known.
FILE_ROWS = 50_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    ``rows`` is a known bound of its rows, for tables of a few numbers a row: they go
    to files of about FILE_ROWS rows, and not to one for each shuffle partition, but
    to as many as the cluster has cores at least.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // FILE_ROWS))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, and bytes, that Spark hands to a Python worker at once, where whole texts go there.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def modest_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows and ``size`` bytes if they are larger.

    A batch of texts stands in the memory of the JVM and of the worker at once;
    with Spark's default of 10,000 rows and 64 MB some long texts would fill both.
    Spark reads the setting when a plan runs, so it stays with the session.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number = re.match(r"\d+", spark.conf.get(name))
    if not number or not 0 < int(number[0]) <= size:
        spark.conf.set(name, str(size))


def release(spark: SparkSession) -> None:
    """Delete every table this application wrote here; frames that still read them become invalid."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_or_shuffled(df: DataFrame, rows: int, row_bytes: int, limit_mb: int = 32) -> DataFrame:
    """Hint a broadcast only where the counted rows prove the size; a shuffled hash join beyond it."""
    return df.hint("broadcast" if rows * row_bytes <= limit_mb << 20 else "shuffle_hash")
