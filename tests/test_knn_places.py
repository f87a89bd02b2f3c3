"""Neighbours of many train rows: cells by place, the same as plain differences."""
import numpy as np
from pyspark.sql import functions as F

from fleetpulse.operators import knn


def frames(spark, points, ids, split):
    rows = [(int(i), [float(v) for v in x], bool(s)) for i, x, s in zip(ids, points, split)]
    df = spark.createDataFrame(rows, "id long, v array<double>, q boolean").repartition(4)
    return df.where("not q"), df.where("q")


def check(spark, points, ids, split, k=4):
    train, queries = frames(spark, points, ids, split)
    got = {(r["query"], r["rank"]): (r["neighbour"], r["distance"]) for r in knn.knn_join(train, queries, "id", "v", k, block_rows=20).collect()}
    for i in np.flatnonzero(split):
        want = knn._exact(ids[~split], points[~split], points[i], k)
        found = [got[(ids[i], r + 1)] for r in range(k)]
        assert [f[0] for f in found] == list(want[0]) and np.allclose([np.nan if f[1] is None else f[1] for f in found], want[1], equal_nan=True, atol=1e-12)


def test_places_equal_plain_differences(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES", 16)
    rng = np.random.default_rng(3)
    points = np.r_[rng.normal(size=(300, 3)), rng.integers(0, 2, (200, 3)), np.ones((150, 3))]   # spread, ties, one hot vector
    points[5, 1], points[7, 0], points[450, 2] = np.nan, np.inf, np.nan
    ids = rng.permutation(len(points))
    split = rng.random(len(points)) < 0.15
    split[[5, 7]] = True, False
    check(spark, points, ids, split)


def test_places_send_a_query_to_few_cells(spark):
    """On rows along a line the exchange of a query does not grow with the number of cells (16 or more here)."""
    points = np.c_[np.arange(800.0), np.zeros(800)]
    places = knn._Places(points, 4)
    places.boxed([(i, (places.of(points) == i).sum(), points[places.of(points) == i].min(axis=0), points[places.of(points) == i].max(axis=0)) for i in range(16)])
    assert places.n.max() <= 60 and places.n.sum() == 800
    near = places.distances(points) <= 4.0
    sent = near.sum(axis=1)
    assert sent.max() <= 2 and near.any(axis=1).all()
    check(spark, points, np.arange(800), np.arange(800) % 9 == 0)
