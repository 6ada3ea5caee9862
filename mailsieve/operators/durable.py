"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir(application_id: str) -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="mailsieve-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets a folder of its own that goes with the process; a cluster must
    name one, because a machine-local folder is lost with its machine. Named folders are not cleaned up.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return _own_dir(spark.sparkContext.applicationId).name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for written results."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "table", packed: bool = False, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder now and continue from the written table.

    ``buckets`` (how many, of which column) are kept in the session's catalog until ``discard``: joins and groups by that
    column read the table where it lies instead of shuffling it.

    Columns that are ``packed`` already are not compressed again: that gains nothing, and the codec keeps buffers of whole
    pages, which are as long as the rows they hold, outside the heap.

    Later passes read the columns they need and survive the loss of any executor without redoing
    the work behind ``df``.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "uncompressed") if packed else df.write
    if buckets:
        known_as = path.rsplit("/", 1)[1].replace("-", "_")
        writer.bucketBy(*buckets).option("path", path).saveAsTable(known_as, format="parquet")
        table = df.sparkSession.table(known_as)
        table.durable_table = known_as
    else:
        writer.parquet(path)
        table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.durable_path = path
    return table


def is_written(table: DataFrame) -> bool:
    """Whether ``durable`` wrote just this table, so that reading it often needs no further copy."""
    return "durable_path" in vars(table)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` wrote and that no later job reads any more."""
    for table in tables:
        spark = table.sparkSession
        if known_as := vars(table).get("durable_table"):
            spark.sql(f"DROP TABLE IF EXISTS {known_as}")
        path = spark._jvm.org.apache.hadoop.fs.Path(table.durable_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Jobs started inside delete their shuffle files when they end, instead of when the driver next collects garbage.

    For chains of written tables, whose earlier shuffles nothing reads again.
    """
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, size: int) -> contextlib.AbstractContextManager[None]:
    """Jobs started inside hand rows to Python in batches that end at ``size`` bytes; a larger row is a batch of its own.

    For rows of megabytes: the executor holds a batch outside its heap, in buffers that double as they fill.
    """
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))
