"""Spark-side helpers of the subpackage: reads, shared-folder stage tables, row counts."""

from __future__ import annotations

import atexit
import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from fairlease.session import checkpoint_dir

_FOLDERS: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch while a stage table is written: whole texts are large rows, and each
#: batch is held in the executor and in its Python worker.
BATCH_ROWS = 2000


def bound_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows in the session's Arrow batches from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextmanager
def small_batches(spark: SparkSession):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    The lineage is cut, columns stay compressed, and a lost executor only costs the
    tasks that were reading.  The folder goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(_remove_folders)
    _FOLDERS.append((spark, path))
    with small_batches(spark):
        df.write.parquet(path)
    # the shuffle files behind the table are of no more use; Spark drops them once their plan is collected
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _remove_folders() -> None:
    for spark, path in _FOLDERS:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may be gone by now
            return


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
