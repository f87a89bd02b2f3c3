import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fleetpulse.catalog.views import CLASSES, READINGS
from fleetpulse.operators import drift as dr
from fleetpulse.operators import metrics as mt
from fleetpulse.operators import prepare as pr


@pytest.fixture(scope="module")
def two(spark):
    """Six rows, two classes, tied scores."""
    data = [("a", [0.9, 0.1]), ("a", [0.8, 0.2]), ("b", [0.8, 0.2]), ("a", [0.4, 0.6]), ("b", [0.3, 0.7]), ("b", [0.1, 0.9])]
    return spark.createDataFrame(data, "label string, probs array<double>")


def test_two_class_curves(two):
    auc = {r["class"]: r["auc"] for r in mt.roc_auc(two, ["a", "b"]).collect()}
    # pairs (positive, negative) ordered rightly, ties half: a: 3+2.5+2 of 9
    assert auc["a"] == pytest.approx(7.5 / 9) and auc["b"] == pytest.approx(7.5 / 9)
    pts = mt.pr_curve(two, ["a", "b"]).where("class = 'a'").orderBy(F.desc_nulls_last("threshold")).collect()
    assert [round(p["precision"], 4) for p in pts] == [1.0, 0.6667, 0.75, 0.6, 0.5, 1.0]
    assert pts[-1]["threshold"] is None and pts[-1]["recall"] == 0.0


def test_curve_layouts_agree(scored):
    for fn in (mt.roc_curve, mt.pr_auc, mt.thresholds_for_recall):
        assert rows(fn(scored, CLASSES, layout="plain")) == rows(fn(scored, CLASSES, layout="chunked", chunk_rows=50))


def test_thresholds_fall_back_to_argmax(two):
    none_fires = mt.apply_thresholds(two, ["a", "b"], {"a": 2.0, "b": 2.0})
    same = mt.predict_argmax(two, ["a", "b"], "want")
    assert [r["predicted_fault"] for r in none_fires.collect()] == [r["want"] for r in same.collect()]


def test_target_recall_is_reached(scored):
    t = {r["class"]: r["threshold"] for r in mt.thresholds_for_recall(scored, CLASSES, 0.9).collect()}
    counts = mt.score_counts(scored, CLASSES)
    for c, limit in t.items():
        hit, total = counts.where(F.col("class") == c).agg(
            F.sum(F.when(F.col("p") >= limit, F.col("tp_n"))), F.sum("tp_n")).first()
        assert hit / total >= 0.9


def test_metrics_of_perfect_and_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("b", "c")], "label string, predicted_fault string")
    m = mt.classification_metrics(df).first()
    assert m["accuracy"] == pytest.approx(2 / 3) and m["precision"] == pytest.approx(2 / 3)
    f1 = {r["class"]: r["f1"] for r in mt.per_class_f1(df, ["a", "b", "c", "d"]).collect()}
    assert f1 == {"a": 1.0, "b": pytest.approx(2 / 3), "c": 0.0, "d": 0.0}


def test_identical_tables_do_not_drift(readings):
    report = dr.drift_report(readings, readings, READINGS, ["speed", "voltage"]).collect()
    assert all(r["psi"] == 0 and r["ks_statistic"] == 0 and r["ks_pvalue"] == 1.0 for r in report)


def test_shifted_table_is_severe_and_layouts_agree(readings):
    far = readings.withColumn("speed", F.col("speed") + 100)
    one = dr.drift_report(readings, far, READINGS, ["speed", "voltage"], layout="plain")
    r = {x["feature"]: x for x in one.collect()}
    assert r["speed"]["psi_level"] == "severe" and r["speed"]["ks_statistic"] == 1.0 and r["voltage"]["psi_level"] == "stable"
    assert rows(one, 6) == rows(dr.drift_report(readings, far, READINGS, ["speed", "voltage"], layout="chunked"), 6)


def test_drift_edges(spark, readings):
    flat = readings.withColumn("k", F.lit(3.0))
    assert dr.drift_report(flat, flat, READINGS, ["k"]).first()["psi"] == 0.0
    few = readings.limit(4)
    assert dr.drift_report(few, readings, READINGS, ["speed"]).count() == 0
    empty = dr.drift_report(readings.select("ts", "speed"), readings.select("ts", "voltage"), READINGS)
    assert empty.count() == 0 and dr.drift_summary(empty).first()["overall"] == "unknown"


def test_split_is_exact_and_repeatable(readings):
    split = pr.stratified_split(readings, "fault_type", "event_id")
    for r in split.groupBy("fault_type").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert r["t"] == math.ceil(r["n"] * 0.2)
    keyed = lambda d: rows(d.select("event_id", "split"))
    assert keyed(split) == keyed(pr.stratified_split(readings.repartition(3), "fault_type", "event_id", layout="chunked"))
    with pytest.raises(ValueError):
        pr.stratified_split(readings.limit(9), "fault_type", "event_id")


def test_scaler_stage_matches_function(readings, spark):
    from fleetpulse.session import scratch_path

    stage = pr.ColumnScaler(columns=["speed", "voltage"]).fit(readings)
    path = scratch_path(spark, "scaler")
    stage.write().save(path)
    again = pr.ColumnScalerModel.load(path).transform(readings).select("event_id", "speed", "voltage")
    want = pr.standardize(readings, ["speed", "voltage"], split=None).select("event_id", "speed", "voltage")
    assert rows(again, 6) == rows(want, 6)


def test_chunked_report_computes_its_rows_once(spark):
    """Edges, bins, distances and means read the written counts: the input is not computed again for each."""
    df = spark.range(4000).select((F.col("id") % 2 == 0).alias("early"), (F.col("id") * 7919 % 1009 / 7.0).alias("a"),
                                  F.sqrt(F.col("id") % 501).alias("b"))
    long = dr.sided_by(df, F.col("early"), ["a", "b"])
    chunked, plain = (dr.report_of(long, 2, layout) for layout in ("chunked", "plain"))
    assert "Range" not in chunked._jdf.queryExecution().optimizedPlan().toString()
    for got, want in zip(chunked.collect(), plain.collect(), strict=True):
        assert got["feature"] == want["feature"] and all(abs(got[c] - want[c]) < 1e-9 for c in ("psi", "ks_statistic", "mean_shift"))
