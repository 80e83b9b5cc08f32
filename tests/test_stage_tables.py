"""Stage tables keep rows and types, and are read by column."""

from pyspark.sql import functions as F

from fairlease.session import materialize


def test_a_stage_table_is_read_by_column(spark):
    df = spark.range(100).select("id", F.concat(F.lit("k"), "id").alias("name"), F.array_join(F.array_repeat("id", 50), "-").alias("wide"))
    kept = materialize(df)
    assert kept.schema.names == df.schema.names and kept.exceptAll(df).isEmpty() and kept.count() == 100
    plan = kept.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan.lower() and "wide" not in plan
    assert materialize(df.where("id < 0")).collect() == []


def test_a_stage_table_keeps_what_parquet_cannot_hold(spark):
    df = spark.range(2).select("id", F.lit(None).alias("void"), F.col("id").alias("ID"))
    assert sorted(map(tuple, materialize(df).collect())) == [(0, None, 0), (1, None, 1)]
