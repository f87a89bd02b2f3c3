"""Registered training queries hand over no cut budget."""
import pytest

from fleetpulse.catalog import models as catalog
from fleetpulse.catalog.registry import QUERIES
from fleetpulse.operators import models as md


@pytest.fixture
def handed(spark, monkeypatch):
    seen = {}

    def train(name, data, schema, params=None):
        seen[name] = params or {}
        return md.Trained(name, None, spark.createDataFrame([(1, "Normal", "Normal")], "event_id long, label string, predicted_fault string"), 0.0, 0.0)
    monkeypatch.setattr(catalog.md, "train_model", train)
    monkeypatch.setattr(catalog, "separable", lambda *_: None)
    monkeypatch.setattr(catalog, "prepared", lambda *_: None)
    return seen


def test_boosted_and_logistic_run_their_defaults(spark, handed):
    QUERIES["train_boosted_small_rate"](spark, "")
    QUERIES["train_logistic"](spark, "")
    assert handed == {"LightGBM": {}, "Logistic Regression": {}}
    boost, logistic = md.build_model("LightGBM"), md.build_model("Logistic Regression").make(0.1)
    assert (boost.rounds, boost.rate, logistic.getMaxIter()) == (300, 0.05, 2000)


def test_train_all_compares_every_model(spark, handed):
    out = {r["model"]: r for r in QUERIES["train_all"](spark, "").collect()}
    assert set(out) == set(md.model_names()) and len(out) == 7 and all(p == {} for p in handed.values())
    assert all(r["f1"] == 1.0 and r["train_seconds"] == r["predict_seconds"] == 0.0 for r in out.values())
