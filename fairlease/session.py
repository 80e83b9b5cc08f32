"""Session helpers.

``get_spark`` is for tests, the bench and local runs; on a cluster the
caller's session is used as is.  ``checkpoint_dir`` reads the shared
``spark.checkpoint.dir`` the cluster names.  Only a local session without one
gets a private folder, which goes when the process ends.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "fairlease") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # delete reliable-checkpoint files once their DataFrame is unreachable (else they pile up)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one only for a local session that names none."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="fairlease-ckpt-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


_STAGES: list[tuple[SparkSession, str]] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read back (survives executor loss).

    A reader takes only the columns it needs, and joins see the table's real size before they are planned.
    The folder goes when the driver's Python ends.  Columns that Parquet cannot hold (of no type, or two of
    one name) go to a reliable checkpoint.
    """
    folder = checkpoint_dir(df.sparkSession)
    names = [c.lower() for c in df.columns]
    if not names or len(set(names)) < len(names) or "void" in df.schema.simpleString():
        return df.checkpoint(eager=True)
    path = f"{folder.rstrip('/')}/stage-{uuid.uuid4().hex}"
    if not _STAGES:
        atexit.register(_remove_stages)
    _STAGES.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove_stages() -> None:
    for spark, path in _STAGES:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may be gone by now
            return


def load_tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def materialize(df: DataFrame, mode: str = "checkpoint") -> DataFrame:
    """Stage boundary for a table that several downstream operators re-read.

    ``checkpoint``: a Parquet table in the shared ``spark.checkpoint.dir``
    (lineage cut, survives executor loss, see :func:`cut_lineage`); ``persist``: memory+disk cache, recomputed
    from lineage if blocks are lost; ``none``: no boundary.
    """
    from pyspark import StorageLevel

    if mode == "checkpoint":
        return cut_lineage(df)
    if mode == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if mode == "none":
        return df
    raise ValueError(f"unknown materialize mode {mode!r}")
