"""The streaming valuation equals the batch valuation on the same listings; versions and dead letters."""

import json
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from fairlease.plans import catalog, frozen, valuation
from fairlease.sources import binding
from fairlease.streaming.valuation_stream import ArtifactSource, value_stream

SF = "/root/testdata/sf0.001"


def folder(name):
    return f"{tempfile.mkdtemp(prefix='fairlease-')}/{name}"


def rounded(df):
    cols = list(valuation.VALUATION_COLUMNS)
    return df.select(*[F.round(c, 6).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in cols])


def frozen_art(spark):
    return frozen.frozen_artifacts(catalog.flagged_query(spark, SF), catalog._model_rows(spark, SF))


def test_stream_equals_batch(spark):
    rows = catalog._model_rows(spark, SF)
    art = valuation.fit_artifacts(rows, k=3, restarts=1, trees=20)
    stored = valuation.save_artifacts(art, folder("a"))
    assert len(art.metadata["features"]) == 46
    listings = binding.listings(spark, SF)
    src, out = folder("in"), folder("out")
    listings.repartition(3).write.mode("overwrite").parquet(src)
    q = value_stream(spark, src, out, folder("ckpt"), stored, listings.schema, max_files_per_trigger=1)
    q.awaitTermination(600)
    streamed = spark.read.parquet(out).drop("batch_id")
    batch = valuation.value_listings(spark.read.parquet(src), art)
    assert streamed.count() == batch.count() == listings.count()
    assert rounded(streamed).exceptAll(rounded(batch)).count() == 0


def test_scoring_is_one_pass(spark):
    listings = binding.listings(spark, SF)
    plan = valuation.value_listings(listings, frozen_art(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") <= 1 and plan.count("Relation [l_orderkey") <= 1


def test_readers_take_the_newest_complete_version(spark):
    root = folder("root")
    assert valuation.newest_version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        valuation.load_newest(spark, root)
    art = frozen_art(spark)
    first = valuation.publish_artifacts(art, root)
    art.metadata = art.metadata | {"confidence_level": 0.9}
    second = valuation.publish_artifacts(art, root)
    valuation.save_artifacts(art, f"{root}/v{'9' * 20}-half")  # a writer that died before the mark
    assert valuation.newest_version(spark, root).endswith(second.rsplit("/", 1)[1]) and first != second
    assert valuation.load_newest(spark, root).metadata["confidence_level"] == 0.9


def test_dead_letters_and_reload_between_batches(spark):
    listings = catalog.flagged_query(spark, SF)
    listings = listings.select("row_key", *[c for c in listings.columns if c != "row_key"]).limit(40)
    lines = [r["l"] for r in listings.select(F.to_json(F.struct("*")).alias("l")).collect()]
    bad = ["{", "not json", "", '{"gu_name": "no key"}', lines[0][:50]]
    root, src, out, dead, ckpt = (folder(x) for x in ("root", "in", "out", "dead", "ckpt"))
    art = frozen_art(spark)
    valuation.publish_artifacts(art, root)
    spark.createDataFrame([(x,) for x in lines[:20] + bad], "value string").coalesce(1).write.text(src)
    run = lambda: value_stream(spark, src, out, ckpt, root, listings.schema, fmt="text", dead_letters=dead).awaitTermination(600)
    run()
    assert sorted(r["line"] for r in spark.read.parquet(dead).collect()) == sorted(bad)
    source = ArtifactSource(spark, root)
    before = source.current()[1]
    valuation.publish_artifacts(art, root)
    assert source.current()[1] != before
    spark.createDataFrame([(x,) for x in lines[20:]], "value string").coalesce(1).write.mode("append").text(src)
    run()
    got = spark.read.parquet(out)
    assert got.count() == 40 and got.select("artifact_version").distinct().count() == 2
    want = valuation.value_listings(listings.where(F.col("row_key").isin([json.loads(x)["row_key"] for x in lines])), art)
    assert rounded(got).exceptAll(rounded(want)).count() == 0
    with pytest.raises(Exception):  # without a folder for them broken lines are an error
        value_stream(spark, src, folder("out"), folder("ckpt"), root, listings.schema, fmt="text").awaitTermination(600)


def test_the_best_registered_run_is_fitted_and_published(spark):
    rows = catalog._model_rows(spark, SF)
    registry = valuation.spec_registry(spark, {"shallow": {"kind": "rf", "maxDepth": 3, "numTrees": 5}, "deep": {"kind": "rf", "maxDepth": 5, "numTrees": 5}})
    score = lambda model, rmse, split="test": ("e", model, split, rmse, rmse, 1 - rmse)
    scores = spark.createDataFrame([score("deep", 0.4), score("shallow", 0.3), score("unknown", 0.1), score("deep", 0.2, "valid")], "experiment string, model string, split string, rmse double, mae double, r2 double")
    assert valuation.chosen_spec(scores, registry)[0] == "shallow"
    with pytest.raises(ValueError):
        valuation.chosen_spec(scores.where("model = 'unknown'"), registry)
    root = folder(uuid.uuid4().hex)
    valuation.fit_best(rows, scores, registry, root, k=3, restarts=1, trees=10)
    art = valuation.load_newest(spark, root)
    assert art.metadata["model"] == "shallow" and art.model.stages[-1].getNumTrees == 5


def test_the_streams_lines_are_compressed_and_many_files_make_a_batch(spark, monkeypatch):
    from fairlease.streaming import valuation_stream

    seen, stream = {}, valuation_stream.value_stream

    def record(spark, src, *args, **kwargs):
        files = spark.read.text(src).inputFiles()
        seen.update(files=files, per_batch=kwargs["max_files_per_trigger"], lines=spark.read.text(src).count())
        return stream(spark, src, *args, **kwargs)

    monkeypatch.setattr(valuation_stream, "value_stream", record)
    out = catalog.REGISTRY["valuation_stream"][0](spark, SF)
    n = catalog._sources(spark, SF)[0].count()
    assert out.count() == n == seen["lines"] and out.select("row_key").distinct().count() == n
    assert all(f.endswith(".gz") for f in seen["files"]) and len(seen["files"]) >= 24 and 8 <= seen["per_batch"] < len(seen["files"])
