"""Many-class softmax boosting: separable classes, probabilities, falling loss, and the same trees however the rows are split."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql import functions as F

from fleetpulse.operators.boosting import SoftmaxBoost


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1200):
        c = i % 4
        x = rng.normal(0, 1, 5)
        x[0] += 3 * c
        x[3] = np.nan if i % 50 == 0 else x[3]
        rows.append((i, Vectors.dense(x.tolist()), c, 1.0 + (c == 3)))
    schema = StructType([StructField("id", LongType()), StructField("features", VectorUDT()),
                         StructField("label_index", IntegerType()), StructField("weight", DoubleType())])
    return spark.createDataFrame(rows, schema)


def loss(model, df):
    x = np.array([r.features.toArray() for r in df.collect()])
    y = np.array([r.label_index for r in df.collect()])
    m = model.margins(x)
    p = np.exp(m - m.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return -np.log(p[np.arange(len(y)), y]).mean()


def test_learns_many_classes(table):
    model = SoftmaxBoost(maxIter=12, stepSize=0.3, maxDepth=3, weightCol="weight", refresh=5).fit(table)
    assert len(model.trees) == 12 and all(len(t) == 4 for t in model.trees)
    out = model.transform(table).collect()
    assert all(abs(sum(r.probs) - 1) < 1e-9 for r in out)
    assert np.mean([r.prediction == r.label_index for r in out]) > 0.9
    assert out[0].id is not None and set(out[0].asDict()) >= {"id", "features", "probs", "prediction"}
    short = SoftmaxBoost(maxIter=3, stepSize=0.3, maxDepth=3, weightCol="weight").fit(table)
    assert loss(model, table) < loss(short, table)


def test_same_trees_however_split(table):
    a = SoftmaxBoost(maxIter=3, stepSize=0.2, maxDepth=2, refresh=2).fit(table.repartition(1))
    b = SoftmaxBoost(maxIter=3, stepSize=0.2, maxDepth=2, refresh=2).fit(table.repartition(7), edges=a.edges)
    for ra, rb in zip(a.trees, b.trees):
        for ta, tb in zip(ra, rb):
            assert (ta.feature == tb.feature).all() and (ta.threshold == tb.threshold).all()
            assert np.allclose(ta.value, tb.value)


def test_splits_summed_by_node_are_the_drivers(table, monkeypatch):
    """Large histograms are summed by Spark and split in the tasks: the same trees, over refreshes too."""
    from fleetpulse.operators import boosting
    fit = lambda: SoftmaxBoost(maxIter=4, stepSize=0.2, maxDepth=3, refresh=2, weightCol="weight").fit(table.repartition(3))
    a = fit()
    monkeypatch.setattr(boosting, "AT_ONCE", 0)
    b = fit()
    assert all(np.array_equal(e, f) for e, f in zip(a.edges, b.edges))
    for ta, tb in zip(sum(a.trees, []), sum(b.trees, [])):
        assert (ta.feature == tb.feature).all() and (ta.threshold == tb.threshold).all() and np.allclose(ta.value, tb.value)
