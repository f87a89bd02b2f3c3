import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from fleetpulse.catalog.ranking import FEATURES, MODEL, TARGET, features_z
from fleetpulse.catalog.views import CLASSES, READINGS
from fleetpulse.operators import attribution as at
from fleetpulse.operators import features as ft
from fleetpulse.operators import isolation as iso
from fleetpulse.operators import knn
from fleetpulse.operators import metrics as mt
from fleetpulse.operators import models as md
from fleetpulse.operators.counterfactual import counterfactual
from fleetpulse.session import scratch_path
from fleetpulse.streaming import jobs


def test_knn_matches_brute_force_over_blocks(spark):
    emb = spark.read.parquet(f"{SMALL}/embeddings.parquet").limit(120)
    train, queries = emb.where("vec_id % 4 > 0"), emb.where("vec_id % 4 = 0")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in knn.knn_join(train, queries, "vec_id", "embedding", 5, block_rows=20).collect()}
    t, q = train.toPandas(), queries.toPandas()
    points = np.stack(t["embedding"]).astype(float)
    for qid, x in zip(q["vec_id"], q["embedding"]):
        d = np.sqrt(((points - np.asarray(x, float)) ** 2).sum(axis=1))
        want = t["vec_id"].to_numpy()[np.lexsort((t["vec_id"], d))[:5]]
        assert [got[(qid, i + 1)] for i in range(5)] == list(want)


def test_exact_match_takes_the_vote(spark):
    near = spark.createDataFrame([(1, 10, 0.0, 1), (1, 11, 0.5, 2)], "query long, neighbour long, distance double, rank int")
    labels = spark.createDataFrame([(10, "x"), (11, "y")], "id long, label string")
    assert [(r["class"], r["p"]) for r in knn.knn_classify(near, labels, "id", "label").collect()] == [("x", 1.0)]


def test_shapley_adds_up(spark):
    df = features_z(spark, SMALL)
    phi = at.shapley_attribution(df, MODEL.probabilities, FEATURES, CLASSES, "event_id", max_rows=6, permutations=4)
    total = phi.groupBy("event_id", "class").agg((F.sum("phi") + F.first("base_value")).alias("t"))
    want = MODEL.probabilities(df).select("event_id", F.posexplode("probs").alias("i", "p")).withColumn(
        "class", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("i") + 1))
    both = total.join(want, ["event_id", "class"]).collect()
    assert len(both) == 6 * len(CLASSES) and all(abs(r["t"] - r["p"]) < 1e-9 for r in both)


def test_counterfactual_moves_toward_target(spark):
    df = features_z(spark, SMALL).limit(40)
    out = counterfactual(df, MODEL.probabilities, FEATURES, len(CLASSES), TARGET, "event_id", step=0.5, max_steps=6)
    got = out.collect()
    assert len(got) == 40
    for r in got:
        assert r["success"] == (r["final_class"] == TARGET)
        if r["original_class"] == TARGET:
            assert r["steps"] == 0 and all(r[f"d_{f}"] == 0 for f in FEATURES)


def test_isolation_forest_finds_far_points(spark, readings):
    df = readings.select("event_id", "speed", "voltage").withColumn(
        "speed", F.when(F.col("event_id") < 5, 500.0).otherwise(F.col("speed")))
    nodes = iso.fit_isolation_forest(df, ["speed", "voltage"], "event_id", trees=20)
    out = iso.flag_anomalies(iso.score_isolation(df, nodes, ["speed", "voltage"]), "score", 0.05)
    assert out.where("event_id < 5 and is_anomaly").count() == 5
    again = iso.fit_isolation_forest(df.repartition(5), ["speed", "voltage"], "event_id", trees=20)
    assert rows(nodes) == rows(again)


@pytest.fixture(scope="module")
def learnable(readings):
    shift = {c: i * 8.0 for i, c in enumerate(CLASSES)}
    level = F.create_map(*[F.lit(x) for kv in shift.items() for x in kv])[F.col("fault_type")]
    return md.prepare_training(readings.withColumn("speed", F.col("speed") / 10 + level), READINGS)


@pytest.mark.parametrize("name,params", [("Decision Tree", {"maxDepth": 6}), ("Logistic Regression", {"maxIter": 60}),
                                         ("Random Forest", {"numTrees": 12, "maxDepth": 8})])
def test_models_learn_and_probabilities_sum_to_one(learnable, name, params):
    t = md.train_model(name, learnable, READINGS, params)
    assert mt.classification_metrics(t.predictions).first()["f1"] > 0.6
    bad = t.predictions.where(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9)
    assert bad.count() == 0


def test_unknown_model_is_refused():
    with pytest.raises(ValueError):
        md.build_model("Oracle")


def test_calibration_does_not_worsen_ece(scored):
    before = mt.expected_calibration_error(scored, CLASSES).first()["ece"]
    after = md.calibrate(scored, CLASSES, "isotonic").transform(scored)
    assert mt.expected_calibration_error(after, CLASSES).first()["ece"] < before


@pytest.fixture(scope="module")
def parts(spark, readings):
    """The readings as four files in time order."""
    path = scratch_path(spark, "parts")
    for i in range(4):
        readings.withColumn("ts", F.col("ts").cast("timestamp")).where(f"floor((day(ts) - 1) / 8) = {i}").coalesce(1).write.mode("append").parquet(path)
    return path


def test_rolling_stream_over_batches_equals_batch(spark, readings, parts):
    stream = jobs.file_stream(spark, parts, files_per_batch=1)
    got = jobs.run_to_table(jobs.rolling_stream(stream, READINGS, 5, ["speed", "battery_level"]), "roll")
    want = ft.rolling_features(readings, READINGS, 5, ["speed", "battery_level"]).select(*got.columns)
    assert rows(got, 6) == rows(want, 6)


def test_rolling_statistics_equal_pandas():
    rng = np.random.default_rng(5)
    values = rng.normal(50, 20, (90, 3))
    values[rng.random(values.shape) < 0.2] = np.nan
    values[20:40, 0], values[5, 1], values[50:65, 2] = np.nan, np.inf, 3.3
    place = np.concatenate([np.arange(60), np.arange(30)])
    got = jobs.rolling_statistics(values, place, 10, block=16)
    for part in (slice(0, 60), slice(60, 90)):
        df = pd.DataFrame(values[part])
        frames = df.rolling(10, min_periods=1)
        want = np.stack([frames.mean(), frames.std().fillna(0.0), (frames.max() - frames.min()).fillna(0.0),
                         (df ** 2).rolling(10, min_periods=1).sum()], axis=2).reshape(len(df), -1)
        np.testing.assert_allclose(got[part], want, rtol=1e-9, atol=1e-9)


def test_rolling_stream_takes_systems_together(spark, parts, monkeypatch):
    """The groups that Spark makes do not grow with the systems, and a null system is one of its own."""
    plan = jobs.rolling_stream(jobs.file_stream(spark, parts), READINGS, 5, ["speed"])._jdf.queryExecution().analyzed().toString()
    assert "xxhash64(system_id" in plan
    source = spark.read.parquet(parts)
    path = scratch_path(spark, "null-systems")
    source.withColumn("system_id", F.when(F.col("event_id") % 3 > 0, F.col("system_id"))).repartition(3).write.parquet(path)
    monkeypatch.setattr(jobs, "ROLLING_GROUPS", 1)
    got = jobs.run_to_table(jobs.rolling_stream(jobs.file_stream(spark, path), READINGS, 5, ["speed"]), "roll")
    want = ft.rolling_features(spark.read.parquet(path), READINGS, 5, ["speed"]).select(*got.columns)
    assert rows(got, 6) == rows(want, 6)


def test_recent_and_counts_over_batches(spark, readings, parts):
    stream = jobs.file_stream(spark, parts, files_per_batch=1)
    out = jobs.run_to_table(jobs.recent_stream(stream, READINGS, ["speed"], 3), "recent", "update")
    last = out.groupBy("system_id").agg(F.max("batch").alias("batch"))
    got = out.join(last, ["system_id", "batch"]).select("event_id")
    from fleetpulse.operators.ordering import positions
    want = positions(readings, "system_id", [F.desc("ts"), F.desc("event_id")]).where("idx < 3").select("event_id")
    assert rows(got) == rows(want)
    rate = jobs.newest(jobs.run_to_table(jobs.fault_rate_stream(stream, READINGS), "rate", "update"),
                       ["window_start", "window_end", "fault_type"])
    assert rate.agg(F.sum("count")).first()[0] == readings.count()


def test_catalog_is_consistent():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_explaining_queries_keep_the_operators_budgets(spark, monkeypatch):
    """The registered queries hand over no cut number of trees, rows or permutations."""
    from fleetpulse.catalog import models as catalog
    seen = []
    monkeypatch.setattr(catalog.iso, "fit_isolation_forest", lambda *a, **kw: seen.append((len(a), kw)))
    monkeypatch.setattr(catalog.iso, "score_isolation", lambda df, *a: df.withColumn("score", F.lit(0.0)))
    monkeypatch.setattr(catalog.at, "shapley_attribution", lambda *a, **kw: seen.append((len(a), kw)))
    catalog.isolation_forest(spark, SMALL)
    catalog.shapley_attribution(spark, SMALL)
    assert seen == [(3, {}), (5, {})]


def test_counterfactual_rounds_exchange_nothing(spark, monkeypatch):
    """The moves of a row are compared in the row: of unique keys no round shuffles or sorts its moves."""
    from fleetpulse.operators import counterfactual as cf

    plans, keep = [], cf.stable
    monkeypatch.setattr(cf, "stable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    df = spark.range(40).select(F.col("id").alias("event_id"), *[((F.col("id") * (j + 3)) % 11 - 5.0).alias(f) for j, f in enumerate(FEATURES)])
    search = lambda d: cf.counterfactual(d, MODEL.probabilities, FEATURES, len(CLASSES), TARGET, "event_id", step=0.5, max_steps=2)
    once = rows(search(df))
    assert len(plans) == 3 and not any("Exchange" in p or "Aggregate" in p for p in plans)
    # repeated keys: the rows still searching meet, as one
    settled = [r for r in once if r[-2] == 0]   # steps
    assert rows(search(df.unionByName(df))) == sorted(once + settled, key=repr)


def test_knn_ties_copies_and_odd_numbers():
    """A block's search equals plain differences: copies, ties by id, NaN and infinite numbers, offsets that cancel."""
    rng = np.random.default_rng(1)
    for trial in range(40):
        n, m, width, k = (int(rng.integers(1, top)) for top in (400, 40, 20, 9))
        points = rng.integers(-2, 3, (n, width)).astype(float) if trial % 2 else rng.normal(size=(n, width)) + 1e5 * (trial % 6 == 0)
        queries, ids = np.r_[rng.normal(size=(m, width)), points[:5]], rng.integers(0, 500, n)
        if trial % 5 == 0:
            points[0, 0] = np.nan
        if trial % 7 == 0:
            queries[0, 0], points[-1, -1] = np.nan, np.inf
        got = {}
        for at, neighbours, distances in knn._nearest(ids, points, queries, k):
            for i, *best in zip(at, neighbours, distances):
                got.setdefault(i, []).append(best)
        for i, x in enumerate(queries):
            want = knn._exact(ids, points, x, k)
            assert [b[0] for b in got[i]] == list(want[0]) and np.array_equal([b[1] for b in got[i]], want[1], equal_nan=True)


def test_knn_block_measures_few_pairs():
    """4,096 queries against 16,384 points of 64 numbers: a matrix product, not a pass over all differences (over 100 s)."""
    import time

    rng = np.random.default_rng(2)
    points, queries = rng.normal(size=(16_384, 64)), rng.normal(size=(4_096, 64))
    start = time.perf_counter()
    assert sum(len(part[0]) for part in knn._nearest(np.arange(16_384), points, queries, 7)) == 7 * 4_096
    assert time.perf_counter() - start < 20


def test_isolation_paths_equal_a_plain_walk():
    """Leaves lead to themselves; every point gets depth + expected rest of the leaf it falls into, bit for bit."""
    import numpy as np

    from fleetpulse.operators import isolation as iso

    rng = np.random.default_rng(3)
    forest = []
    for _ in range(5):
        nodes, todo = [], [(0, 0)]
        while todo:
            node, level = todo.pop(0)
            stops = level == 6 or (level and rng.random() < 0.3)
            below = [node + len(todo) + 1, node + len(todo) + 2]
            nodes.append((-1, 0.0, -1, -1, int(rng.integers(1, 9))) if stops else (int(rng.integers(4)), float(rng.normal()), *below, 9))
            todo += [] if stops else [(b, level + 1) for b in below]
        forest.append(tuple(np.array([n[c] for n in nodes]) for c in range(5)))
    forest.append(tuple(np.array([v]) for v in (-1, 0.0, -1, -1, 1)))  # a single leaf
    points = rng.normal(size=(5000, 4))
    points[7, 2] = np.nan
    want = np.zeros(len(points))
    for feature, cut, left, right, size in forest:
        for k, p in enumerate(points):
            at, depth = 0, 0
            while feature[at] >= 0:
                at, depth = (left if p[feature[at]] < cut[at] else right)[at], depth + 1
            want[k] += depth + iso._expected_path(size[at])
    assert (iso._path_lengths(points, [iso._walkable(*t) for t in forest], block=512) == want).all()
    assert len(iso._path_lengths(points[:0], [iso._walkable(*t) for t in forest])) == 0
