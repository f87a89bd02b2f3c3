"""The search in one pass: the same as round by round, and whole in the registered queries."""
import numpy as np
from pyspark.sql import functions as F

from conftest import rows
from fleetpulse.catalog import ranking
from fleetpulse.catalog.ranking import FEATURES, MODEL, TARGET
from fleetpulse.catalog.views import CLASSES
from fleetpulse.operators.counterfactual import counterfactual

ARGS = (FEATURES, len(CLASSES), TARGET, "event_id")


def table(spark, n=60):
    return spark.range(n).select(F.col("id").alias("event_id"), *[((F.col("id") * (j + 3)) % 11 - 5.0).alias(f) for j, f in enumerate(FEATURES)])


def test_one_pass_equals_rounds(spark):
    df = table(spark)
    for movable, limit in ((None, 4), (FEATURES[:2], 3), (FEATURES[3:5], 0)):
        search = lambda score, d: rows(counterfactual(d, score, *ARGS, movable=movable, step=0.5, max_steps=limit))  # noqa: B023, E731
        assert search(MODEL, df) == search(MODEL.probabilities, df)
    # repeated and missing keys meet in the first round; a row that misses a feature has no class
    odd = df.unionByName(df.where("event_id < 20").withColumn("speed", F.col("speed") + 1.0)).withColumns({
        "event_id": F.expr("CASE WHEN event_id % 7 > 0 THEN event_id END"),
        "voltage": F.expr("CASE WHEN event_id % 13 > 0 THEN voltage END")})
    search = lambda score: rows(counterfactual(odd, score, *ARGS, step=0.5, max_steps=4))
    assert search(MODEL) == search(MODEL.probabilities)


def test_registered_search_runs_its_rounds(spark, monkeypatch):
    """Rows that need many rounds get them: by hand, one row after the other, up to the operator's 60 rounds."""
    df = table(spark, 40).withColumns({f: F.col(f) * 2.0 for f in FEATURES})
    monkeypatch.setattr(ranking, "features_z", lambda *_: df)
    got = {r["event_id"]: r for r in ranking.search(spark, "").collect()}
    weights, intercepts = np.array(MODEL.weights), np.array(MODEL.intercepts)

    def proba(x):
        e = np.exp(intercepts + weights @ x)
        return e / e.sum()
    most = 0
    for r in df.collect():
        x = np.array([r[f] for f in FEATURES])
        start, p, steps = x.copy(), proba(x), 0
        while p.argmax() != TARGET and steps < 60:
            tries = [x + v * np.eye(len(FEATURES))[j] for j in range(len(FEATURES)) for v in (-ranking.STEP, ranking.STEP)]
            best = max(tries, key=lambda t: proba(t)[TARGET])
            if proba(best)[TARGET] <= p[TARGET]:
                break
            x, p, steps = best, proba(best), steps + 1
        out = got[r["event_id"]]
        assert out["success"] == (p.argmax() == TARGET) and np.allclose([out[f"d_{f}"] for f in FEATURES], x - start)
        assert out["steps"] == (steps if out["success"] else 60)
        most = max(most, steps)
    assert most > 3
