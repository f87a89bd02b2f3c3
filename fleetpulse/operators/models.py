"""Named classifiers as Spark ML estimators, calibration, search, remaining-life regression."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators import explore, metrics
from fleetpulse.operators import prepare as pr
from fleetpulse.operators.knn import knn_classify, knn_join
from fleetpulse.schema import ReadingSchema, numeric_features
from fleetpulse.session import written

FEATURES, LABEL, WEIGHT = "features", "label_index", "weight"
SEED = 42


class RandomFourier(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """√(2/D)·cos(Wx+b) with W ~ N(0, 2γ): an RBF kernel as explicit features (Rahimi & Recht 2007).
    One matrix product per Arrow batch."""

    inputCol = Param(Params._dummy(), "inputCol", "input vector", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output vector", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "number of random features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width; 0 means 1/dimension", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol=FEATURES, outputCol="fourier", size=128, gamma=0.0, seed=SEED):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, size=size, gamma=gamma, seed=seed)

    def _transform(self, df: DataFrame) -> DataFrame:
        size, gamma, seed = (self.getOrDefault(p) for p in (self.size, self.gamma, self.seed))

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            points = np.stack(x.to_numpy())
            d = points.shape[1]
            rng = np.random.default_rng(seed)
            w = rng.normal(0.0, math.sqrt(2.0 * (gamma or 1.0 / d)), (d, size))
            b = rng.uniform(0.0, 2.0 * math.pi, size)
            return pd.Series(list(math.sqrt(2.0 / size) * np.cos(points @ w + b)))

        return df.withColumn(self.getOrDefault(self.outputCol),
                             array_to_vector(project(vector_to_array(self.getOrDefault(self.inputCol)))))


def _base(**kw):
    return {"featuresCol": FEATURES, "labelCol": LABEL, **kw}


def _boosted(depth: int, weighted: bool):
    def make(maxIter=300, stepSize=0.05, maxDepth=depth, **kw):
        tree = GBTClassifier(**_base(maxIter=maxIter, stepSize=stepSize, maxDepth=maxDepth, seed=SEED, **kw))
        return OneVsRest(classifier=tree, weightCol=WEIGHT if weighted else None, **_base())
    return make


class Penalised(Estimator):
    """A learner whose penalty is 1/(C·n): `make(regParam)` is built when the number of training rows is known."""

    def __init__(self, make: Callable, C: float = 1.0):
        super().__init__()
        self.make, self.C = make, C

    def _fit(self, df: DataFrame):
        return self.make(1.0 / (self.C * max(df.count(), 1))).fit(df)


def _svm(C=1.0, maxIter=100, size=128, gamma=0.0):
    def make(penalty: float):
        svc = LinearSVC(featuresCol="fourier", labelCol=LABEL, regParam=penalty, maxIter=maxIter)
        return Pipeline(stages=[RandomFourier(size=size, gamma=gamma),
                                OneVsRest(classifier=svc, featuresCol="fourier", labelCol=LABEL, weightCol=WEIGHT)])
    return Penalised(make, C)


def _logistic(C=1.0, maxIter=2000, **kw):
    return Penalised(lambda penalty: LogisticRegression(
        **_base(family="multinomial", weightCol=WEIGHT, maxIter=maxIter, regParam=penalty, standardization=False, **kw)), C)


@dataclass
class KnnModel:
    """Train rows and k; scoring is a block join."""

    train: DataFrame
    key: str
    k: int
    n_classes: int
    weighted: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        rows = lambda d: d.select(self.key, vector_to_array(FEATURES).alias("__v"))
        votes = knn_classify(knn_join(rows(self.train), rows(df), self.key, "__v", self.k), self.train, self.key, LABEL, self.weighted)
        wide = votes.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct(F.col("class").cast("int"), "p"))).alias("__m"))
        probs = F.array(*[F.coalesce(F.try_element_at("__m", F.lit(i)), F.lit(0.0)) for i in range(self.n_classes)])
        joined = df.join(wide, df[self.key] == wide["query"]).withColumn("probs", probs)
        return joined.withColumn("prediction", metrics.argmax(F.col("probs")).cast("double")).drop("query", "__m")


class Knn(Estimator):
    def __init__(self, k=7, key="event_id", weighted=True):
        super().__init__()
        self.k, self.key, self.weighted = k, key, weighted

    def _fit(self, df: DataFrame) -> KnnModel:
        n = df.agg(F.max(LABEL)).first()[0] + 1
        return KnnModel(df.select(self.key, FEATURES, LABEL), self.key, self.k, int(n), self.weighted)


_MODELS: dict[str, tuple[Callable, Callable]] = {}


def register_model(name: str, factory: Callable, space: Callable[[random.Random], dict]) -> None:
    """`factory(**params)` makes an estimator, `space(rng)` draws parameters for the search."""
    _MODELS[name] = (factory, space)


def build_model(name: str, params: dict | None = None):
    if name not in _MODELS:
        raise ValueError(f"unknown model: {name}")
    return _MODELS[name][0](**(params or {}))


def model_names() -> list[str]:
    return list(_MODELS)


def _log(r: random.Random, lo: float, hi: float) -> float:
    return math.exp(r.uniform(math.log(lo), math.log(hi)))


# Search ranges: fixed values; parameters Spark does not have are left out.
register_model("Random Forest", lambda numTrees=200, maxDepth=30, **kw: RandomForestClassifier(
    **_base(numTrees=numTrees, maxDepth=maxDepth, weightCol=WEIGHT, seed=SEED, **kw)), lambda r: {
    "numTrees": r.randrange(80, 401, 40), "maxDepth": r.randint(4, 24), "minInstancesPerNode": r.randint(1, 6),
    "featureSubsetStrategy": r.choice(["sqrt", "log2", "all"])})
register_model("SVM", _svm, lambda r: {"C": _log(r, 0.1, 20.0), "gamma": _log(r, 1e-4, 1.0)})
register_model("KNN", lambda k=7, key="event_id", weighted=True: Knn(k, key, weighted), lambda r: {
    "k": r.randint(3, 25), "weighted": r.choice([True, False])})
register_model("Logistic Regression", _logistic, lambda r: {"C": _log(r, 0.01, 30.0), "maxIter": r.randrange(800, 4001, 200)})
register_model("Decision Tree", lambda maxDepth=12, **kw: DecisionTreeClassifier(
    **_base(maxDepth=maxDepth, weightCol=WEIGHT, seed=SEED, **kw)), lambda r: {
    "maxDepth": r.randint(3, 30), "minInstancesPerNode": r.randint(1, 6), "impurity": r.choice(["gini", "entropy"])})
def _softmax_boosted(depth: int, weighted: bool):
    """Many-class boosting on softmax gradients (operators/boosting.py): one tree per class and round, no one-vs-rest."""
    def make(maxIter=300, stepSize=0.05, maxDepth=depth, **kw):
        from fleetpulse.operators.boosting import SoftmaxBoost
        return SoftmaxBoost(maxIter=maxIter, stepSize=stepSize, maxDepth=maxDepth, weightCol=WEIGHT if weighted else None,
                            labelCol=LABEL, featuresCol=FEATURES, **kw)
    return make


register_model("LightGBM", _softmax_boosted(10, True), lambda r: {
    "maxIter": r.randrange(100, 601, 50), "stepSize": _log(r, 0.005, 0.2), "maxDepth": r.randint(3, 12),
    "minInstancesPerNode": r.randint(5, 40)})
register_model("XGBoost", _softmax_boosted(6, False), lambda r: {
    "maxIter": r.randrange(100, 601, 50), "stepSize": _log(r, 0.005, 0.2), "maxDepth": r.randint(3, 12),
    "minInstancesPerNode": r.randint(1, 8), "subsamplingRate": r.uniform(0.6, 1.0)})


@dataclass
class Prepared:
    """Train and test rows with `features`, label index and weight, and what is needed to score new rows."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    classes: list[str]
    stages: PipelineModel


def prepare_training(fused: DataFrame, schema: ReadingSchema, test_size: float = 0.2, seed: int = SEED) -> Prepared:
    """Label filter, gap fill, index, stratified split, weights, scaling on the train part, feature vector."""
    names = numeric_features(fused, schema)
    known = pr.fill_gaps(pr.drop_unlabelled(fused, schema), schema, names).na.fill(0.0, names)
    split = pr.stratified_split(pr.encode_label(known, schema.label, LABEL), schema.label, schema.tie, test_size, seed)
    train = pr.with_class_weights(split.where("split = 'train'"), LABEL, WEIGHT).persist()
    test = split.where("split = 'test'").withColumn(WEIGHT, F.lit(1.0)).persist()
    stages = Pipeline(stages=[pr.ColumnScaler(columns=names),
                              VectorAssembler(inputCols=names, outputCol=FEATURES, handleInvalid="keep")]).fit(train)
    keep = [*schema.keys, LABEL, WEIGHT, FEATURES]
    classes = [r[0] for r in train.select(schema.label).distinct().orderBy(schema.label).collect()]
    return Prepared(stages.transform(train).select(*keep), stages.transform(test).select(*keep), names, classes, stages)


def with_probs(df: DataFrame) -> DataFrame:
    """Predictions with `probs` by class position, whatever the model emits."""
    if "probs" in df.columns:
        return df
    if "probability" in df.columns:
        return df.withColumn("probs", vector_to_array("probability"))
    # one-vs-rest margins: the boosted trees' own logistic link, normalised over the classes
    share = F.transform(vector_to_array("rawPrediction"), lambda v: 1.0 / (1.0 + F.exp(-2.0 * v)))
    df = df.withColumn("__s", share)
    total = F.aggregate("__s", F.lit(0.0), lambda a, v: a + v)
    return df.withColumn("probs", F.transform("__s", lambda v: v / total)).drop("__s")


@dataclass
class Trained:
    name: str
    model: object
    predictions: DataFrame
    train_seconds: float
    predict_seconds: float


def train_model(name: str, data: Prepared, schema: ReadingSchema, params: dict | None = None) -> Trained:
    start = time.perf_counter()
    model = build_model(name, params).fit(data.train)
    fitted = time.perf_counter()
    scored = with_probs(model.transform(data.test)).select(
        schema.tie, F.col(schema.label).alias("label"), "probs", F.col("prediction").cast("int").alias("__i"))
    named = scored.withColumn("predicted_fault", F.element_at(F.array(*[F.lit(c) for c in data.classes]), F.col("__i") + 1)).drop("__i")
    kept = written(named, "predictions")    # made once: whatever reads them later does not score again
    return Trained(name, model, kept, fitted - start, time.perf_counter() - fitted)


def train_all(data: Prepared, schema: ReadingSchema, params: dict[str, dict] | None = None,
              names: Sequence[str] | None = None, at_once: int = 3) -> dict[str, Trained]:
    """Every model of `names`, by default all that are registered; `at_once` of them share the cluster."""
    params, names = params or {}, list(names or model_names())
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(names, pool.map(lambda n: train_model(n, data, schema, params.get(n)), names)))


def compare(trained: dict[str, Trained]) -> DataFrame:
    """The comparison table of several trained models with the seconds of fitting and predicting, best macro F1 first."""
    parts = [t.predictions.select(F.lit(n).alias("model"), "label", "predicted_fault") for n, t in trained.items()]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    seconds = F.create_map(*[x for n, t in trained.items() for x in (F.lit(n), F.struct(
        F.lit(t.train_seconds).alias("train"), F.lit(t.predict_seconds).alias("predict")))])[F.col("model")]
    return metrics.model_comparison(stacked).withColumns({"train_seconds": seconds["train"], "predict_seconds": seconds["predict"]})


# --- calibration ---------------------------------------------------------------------------

@dataclass
class Calibrator:
    """One monotone or logistic map per class on the raw score, renormalised over the classes."""

    models: list
    method: str

    def transform(self, df: DataFrame, name: str = "probs") -> DataFrame:
        k = len(self.models)
        out = df
        for i, m in enumerate(self.models):
            if self.method == "isotonic":
                out = m.setPredictionCol(f"__c{i}").transform(out.withColumn("x", F.col(name)[i])).drop("x")
            else:
                value = 1.0 / (1.0 + F.exp(-(F.lit(float(m.coefficients[0])) * F.col(name)[i] + F.lit(float(m.intercept)))))
                out = out.withColumn(f"__c{i}", value)
        total = F.lit(0.0)
        for i in range(k):
            total = total + F.col(f"__c{i}")
        out = out.withColumn("__t", total)
        probs = F.array(*[F.when(F.col("__t") == 0, F.lit(1.0 / k)).otherwise(F.col(f"__c{i}") / F.col("__t")) for i in range(k)])
        return out.withColumn(name, probs).drop("__t", *[f"__c{i}" for i in range(k)])


def calibrate(df: DataFrame, classes: Sequence[str], method: str = "isotonic") -> Calibrator:
    """Fit on (label, probs) rows; each class is fitted on its distinct scores, weighted by their counts."""
    counts = metrics.score_counts(df, classes).persist()
    models = []
    for c in classes:
        part = counts.where(F.col("class") == c)
        if method == "isotonic":
            fit = part.select(F.col("p").alias("x"), (F.col("tp_n") / F.col("n")).alias("label"), F.col("n").cast("double").alias("w"))
            models.append(IsotonicRegression(featuresCol="x", labelCol="label", weightCol="w").fit(fit))
        else:
            sides = part.select(F.col("p"), F.inline(F.array(
                F.struct(F.lit(1.0).alias("label"), F.col("tp_n").cast("double").alias("w")),
                F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("tp_n")).cast("double").alias("w"))))).where("w > 0")
            fit = sides.select(array_to_vector(F.array("p")).alias("x"), "label", "w")
            models.append(LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", maxIter=25).fit(fit))
    counts.unpersist()
    return Calibrator(models, method)


# --- search --------------------------------------------------------------------------------

class MacroF1(Evaluator):
    def _evaluate(self, df: DataFrame) -> float:
        pairs = df.select(F.col(LABEL).cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted_fault"))
        return float(metrics.classification_metrics(pairs).first()["f1"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def search(name: str, data: Prepared, trials: int = 25, folds: int = 3, timeout_seconds: float | None = None,
           seed: int = SEED, limits: dict | None = None) -> DataFrame:
    """Seeded random search over the model's ranges, macro F1 by cross-validation: one row per trial, best first.
    `limits` overrides drawn values. A time limit makes the number of trials depend on the clock, so there is none by default."""
    if name not in _MODELS:
        raise ValueError(f"no search range for {name}")
    rng, start, done = random.Random(seed), time.perf_counter(), []
    for trial in range(trials):
        if done and timeout_seconds is not None and time.perf_counter() - start > timeout_seconds:
            break
        params = {**_MODELS[name][1](rng), **(limits or {})}
        scores = []
        for fold in range(folds):   # no refit on all rows: only the scores are asked for
            held = F.pmod(F.xxhash64(FEATURES, LABEL, F.lit(seed)), F.lit(folds)) == fold
            scores.append(MacroF1().evaluate(build_model(name, params).fit(data.train.where(~held)).transform(data.train.where(held))))
        done.append((trial, sum(scores) / folds, str(dict(sorted(params.items())))))
    rows = data.train.sparkSession.createDataFrame(done, "trial int, f1 double, params string")
    return rows.orderBy(F.desc("f1"), "trial")


# --- remaining life ------------------------------------------------------------------------

def train_rul(fused: DataFrame, schema: ReadingSchema, kind: str = "random_forest", test_size: float = 0.2,
              by_system: bool = True, seed: int = SEED, **params):
    """(model, test predictions with `rul` and `prediction`). Whole systems are held out by default, so that
    neighbouring readings of one system are never on both sides."""
    names = numeric_features(fused, schema)
    labelled = explore.rul_label(fused, schema).withColumn("rul", F.col("rul").cast("double")).na.fill(0.0, names)
    unit = F.xxhash64(F.col(schema.system if by_system else schema.tie), F.lit(seed))
    held = F.pmod(unit, F.lit(10000)) < int(test_size * 10000)
    train, test = labelled.where(~held), labelled.where(held)
    common = {"featuresCol": FEATURES, "labelCol": "rul", "seed": seed}
    learner = (GBTRegressor(**{"maxIter": 100, "maxDepth": 3, **common, **params}) if kind == "gbr"
               else RandomForestRegressor(**{"numTrees": 200, "maxDepth": 30, **common, **params}))
    model = Pipeline(stages=[pr.ColumnScaler(columns=names),
                             VectorAssembler(inputCols=names, outputCol=FEATURES, handleInvalid="keep"), learner]).fit(train)
    return model, model.transform(test).select(schema.tie, schema.system, "rul", "prediction")
