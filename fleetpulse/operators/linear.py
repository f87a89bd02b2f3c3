"""Multinomial linear scores as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import let


@dataclass(frozen=True)
class LinearModel:
    """Class margins `intercept[c] + Σ weight[c][j]·feature[j]`; probabilities are their softmax."""

    classes: tuple[str, ...]
    features: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    @classmethod
    def from_logistic(cls, model, classes: Sequence[str], features: Sequence[str]) -> "LinearModel":
        """From a fitted multinomial `LogisticRegressionModel`."""
        return cls(tuple(classes), tuple(features),
                   tuple(tuple(float(x) for x in row) for row in model.coefficientMatrix.toArray()),
                   tuple(float(x) for x in model.interceptVector))

    def margin(self, c: int) -> Column:
        total = F.lit(self.intercepts[c])
        for name, w in zip(self.features, self.weights[c]):
            total = total + F.lit(w) * F.col(name)
        return total

    def probabilities(self, df: DataFrame, name: str = "probs") -> DataFrame:
        """The expression is built once a session: a search that scores many moves would spend its time building it."""
        return df.withColumn(name, _softmax(self, df.sparkSession))

    def proba(self, columns: Mapping[str, np.ndarray]) -> np.ndarray:
        """The same (class, row) for the columns of a batch: every row by itself, summed in the same order."""
        margins = np.empty((len(self.classes), len(columns[self.features[0]])))
        for c, weights in enumerate(self.weights):
            margins[c] = self.intercepts[c]
            for name, w in zip(self.features, weights):
                margins[c] += w * columns[name]
        exps = np.exp(margins - margins.max(axis=0))
        return exps / exps.sum(axis=0)


@lru_cache(maxsize=4)
def _softmax(model: LinearModel, spark: SparkSession) -> Column:
    """Each intermediate array is bound once, so that filters pushed below this stay small."""
    margins = F.array(*[model.margin(c) for c in range(len(model.classes))])
    exps = let(margins, lambda m: F.transform(m, lambda v: F.exp(v - F.array_max(m))))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return let(exps, lambda e: F.transform(e, lambda v: v / total(e)))


def linear_attribution(df: DataFrame, model: LinearModel, keep: Sequence[str],
                       means: DataFrame | None = None) -> DataFrame:
    """Closed-form contributions on the margin, weight·(x − mean): (…keep, class, feature, value, phi, base_value).

    Long form by a local explode; the means enter as one scalar row.
    """
    df = df.withColumn("__means", (df if means is None else means).agg(
        F.struct(*[F.avg(f).alias(f) for f in model.features]).alias("means")).scalar())
    stats = F.col("__means")
    entries = []
    for c, name in enumerate(model.classes):
        base = F.lit(model.intercepts[c])
        for f, w in zip(model.features, model.weights[c]):
            base = base + F.lit(w) * stats[f]
        for f, w in zip(model.features, model.weights[c]):
            entries.append(F.struct(
                F.lit(name).alias("class"), F.lit(f).alias("feature"), F.col(f).alias("value"),
                (F.lit(w) * (F.col(f) - stats[f])).alias("phi"), base.alias("base_value")))
    return df.select(*keep, F.inline(F.array(*entries)))


def linear_attribution_row(df: DataFrame, model: LinearModel, chosen: Column, keep: Sequence[str],
                           means: DataFrame | None = None) -> DataFrame:
    """The same for one class per row (`chosen`, its index): (…keep, entries, base_value), everything in the row itself."""
    df = df.withColumns({"__means": (df if means is None else means).agg(
        F.struct(*[F.avg(f).alias(f) for f in model.features]).alias("means")).scalar(), "__class": chosen})
    of_class = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("__class"))
    base, entries = of_class(model.intercepts), []
    for j, f in enumerate(model.features):
        weight, mean = of_class([w[j] for w in model.weights]), F.col("__means")[f]
        base = base + weight * mean
        entries.append(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), (weight * (F.col(f) - mean)).alias("phi")))
    return df.select(*keep, F.array(*entries).alias("entries"), base.alias("base_value"))
