"""Value a stream of listings with Structured Streaming.

File source -> ``foreachBatch`` -> the batch ``value_listings`` against static artefacts -> one Parquet
folder per micro-batch id, written with overwrite, so a replayed batch (after a failure) rewrites
the same output instead of duplicating it.  Scoring is per-row against static references, so no state
or watermark is needed and stream output equals batch output on the same rows.

*Lines.*  With ``fmt="text"`` each line is a listing as JSON.  Lines that do not parse, or that lack
``key``, go as they are to ``dead_letters``, one folder a micro-batch beside the output; without
that folder such a line fails the batch.  A line is parsed once: the batch's columns and its broken lines are
kept until both sinks are written.

*Artefacts.*  ``art`` may be fitted artefacts, a folder of them, or the root under which versions are
published (:func:`fairlease.plans.valuation.publish_artifacts`).  Under a root each micro-batch takes the
newest complete version, loaded anew only when it has changed, and names it in ``artifact_version``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlease.plans.valuation import VALUATION_COLUMNS, Artifacts, load_artifacts, newest_version, value_listings

BROKEN = "_broken"


class ArtifactSource:
    """The artefacts of a micro-batch, and the name of their version."""

    def __init__(self, spark: SparkSession, art: Artifacts | str):
        self.spark, self.root, self.version = spark, None, None
        if isinstance(art, str):
            self.version = newest_version(spark, art)
            self.root = art if self.version else None
            art = load_artifacts(spark, self.version or art)
        self.held = art

    def current(self) -> tuple[Artifacts, str | None]:
        if self.root:
            newest = newest_version(self.spark, self.root)
            if newest != self.version:
                self.held, self.version = load_artifacts(self.spark, newest), newest
        return self.held, self.version and self.version.rsplit("/", 1)[1]


def parse_lines(lines: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """Column ``value`` parsed as JSON: ``line``, the schema's columns, and whether the line is ``_broken``."""
    corrupt = "_corrupt"
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = lines.select(F.col("value").alias("line"), F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("row"))
    broken = F.col("row").isNull() | F.col(f"row.{corrupt}").isNotNull() | F.col(f"row.{key}").isNull()
    return parsed.select("line", *[F.col("row")[f.name].alias(f.name) for f in schema.fields], broken.alias(BROKEN))


def value_stream(
    spark: SparkSession, input_dir: str, output_dir: str, checkpoint: str, art: Artifacts | str, schema, fmt: str = "parquet",
    available_now: bool = True, max_files_per_trigger: int | None = None, columns=VALUATION_COLUMNS, dead_letters: str | None = None, key: str = "row_key",
):
    source = ArtifactSource(spark, art)
    lines = fmt == "text"
    reader = spark.readStream.format(fmt)
    if not lines:
        reader = reader.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(input_dir)

    def sink(df: DataFrame, folder: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch_id={batch_id}")

    def valued(batch: DataFrame) -> DataFrame:
        held, version = source.current()
        out = value_listings(batch, held).select(*columns)
        return out.withColumn("artifact_version", F.lit(version)) if version else out

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if not lines:
            return sink(valued(batch), output_dir, batch_id)
        # a good line is worth no place beside its columns
        parsed = parse_lines(batch, schema, key).withColumn("line", F.when(F.col(BROKEN), F.col("line"))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if dead_letters:
                sink(parsed.where(BROKEN).select("line"), dead_letters, batch_id)
            elif not parsed.where(BROKEN).isEmpty():
                raise ValueError("lines that do not parse, and no dead_letters folder")
            sink(valued(parsed.where(~F.col(BROKEN)).drop("line", BROKEN)), output_dir, batch_id)
        finally:
            parsed.unpersist()

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
