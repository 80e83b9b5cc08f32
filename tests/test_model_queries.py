"""Every model query fits on all features of the final model."""

import contextlib

import pytest
from conftest import SF_SMALL

from fairlease.operators import models
from fairlease.plans import catalog


@pytest.mark.parametrize("name", ["tree_models", "tune_search", "oof_predictions", "holdout_predictions", "final_model_roundtrip"])
def test_model_queries_fit_on_every_selected_feature(spark, monkeypatch, name):
    seen = []

    def record(train, valid, cat, num, *args, **kwargs):
        seen.append([*cat, *num])
        raise RuntimeError("recorded")

    monkeypatch.setattr(models, "fit_model", record)
    with contextlib.suppress(Exception):  # how a query goes on without a model is not looked at
        catalog.REGISTRY[name][0](spark, SF_SMALL)
    want = sorted(" ".join(catalog._FEATURE_LIST.values()).split())
    assert len(want) == 46 and seen and all(sorted(x) == want for x in seen)


def test_a_failing_learner_is_no_result(spark, monkeypatch):
    df = spark.createDataFrame([(str(i % 3), float(i), float(i)) for i in range(30)], "c string, x double, target double")
    specs = {"a": {"kind": "rf", "numTrees": 2}, "broken": {"kind": "rf", "numTrees": -1}}
    with pytest.raises(RuntimeError, match="1 of 2 models failed.*broken"):
        models.train_tree_models(df, df, ["c"], ["x"], specs)
    fitted, failures = models.train_tree_models(df, df, ["c"], ["x"], specs, skip_failed=True)
    assert list(fitted) == ["a"] and list(failures) == ["broken"]
    fit = models.fit_model

    def one_fails(train, valid, cat, num, spec, *args, **kwargs):
        if spec.get("maxDepth") == 8:
            raise RuntimeError("no deep forest")
        return fit(train, valid, cat, num, spec, *args, **kwargs)

    monkeypatch.setattr(models, "fit_model", one_fails)
    with pytest.raises(RuntimeError, match="no deep forest"):  # not the shallow one as the best of the two
        catalog.REGISTRY["best_run_published"][0](spark, SF_SMALL)
