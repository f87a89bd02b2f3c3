"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs, and flagging by score."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.operators.ordering import quantiles
from fleetpulse.operators.prepare import random_sample


def score_threshold(df: DataFrame, score: str, contamination: float, layout: str = "auto") -> DataFrame:
    """One row: the score below which `contamination` of the rows lie."""
    keyed = df.select(F.lit(0).alias("__all"), F.col(score).alias("__score"))
    return quantiles(keyed, "__all", "__score", [contamination], layout=layout).select(F.col("q")[0].alias("threshold"))


def flag_anomalies(df: DataFrame, score: str, contamination: float = 0.08, threshold: float | None = None,
                   layout: str = "auto") -> DataFrame:
    """Flag scores strictly below the threshold: the stored one, or that of this batch."""
    cut = F.lit(threshold) if threshold is not None else score_threshold(df, score, contamination, layout).scalar()
    return df.withColumn("is_anomaly", F.col(score) < cut)


TREE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, size int"


def fit_isolation_forest(df: DataFrame, features: Sequence[str], key: str, trees: int = 200, sample: int = 256,
                         seed: int = 42) -> DataFrame:
    """Tree nodes of a forest. A bounded pool of trees·sample rows is drawn by a seeded hash and dealt
    out to the trees (several times if the table is smaller); each tree is built in its own task."""
    pool = random_sample(df.select(F.col(key).cast("string").alias("key"), F.array(*[F.coalesce(f, F.lit(0.0)) for f in features]).alias("x")), "key", trees * sample, seed)
    rows = max(pool.count(), 1)
    copies = -(-trees * sample // rows)
    dealt = pool.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    w = W.partitionBy("__copy").orderBy(F.md5(F.concat_ws("-", "key", F.col("__copy"), F.lit(seed))))  # pool-sized groups
    slot = F.col("__copy") * rows + F.row_number().over(w) - 1
    dealt = dealt.withColumn("tree", F.floor(slot / sample).cast("int")).where(F.col("tree") < trees)
    depth = max(1, math.ceil(math.log2(max(2, min(sample, rows)))))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        x = np.stack(pdf.sort_values("key")["x"].to_numpy()).astype(float)
        nodes, todo = [], [(0, np.arange(len(x)), 0)]
        count = 1
        while todo:
            node, idx, level = todo.pop()
            lo, hi = x[idx].min(axis=0), x[idx].max(axis=0)
            splittable = np.flatnonzero(hi > lo)
            if level >= depth or len(idx) <= 1 or not len(splittable):
                nodes.append((int(key[0]), node, -1, 0.0, -1, -1, len(idx)))
                continue
            f = int(rng.choice(splittable))
            cut = float(rng.uniform(lo[f], hi[f]))
            below = x[idx, f] < cut
            nodes.append((int(key[0]), node, f, cut, count, count + 1, len(idx)))
            todo += [(count, idx[below], level + 1), (count + 1, idx[~below], level + 1)]
            count += 2
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in TREE_SCHEMA.split(", ")])

    return dealt.select("tree", "key", "x").groupBy("tree").applyInPandas(grow, TREE_SCHEMA)


def _expected_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _walkable(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> tuple:
    """A tree whose leaves lead to themselves: feature, cut, the two children of each node side by side, its depth, and
    the path length of each node. Points need no test whether they have arrived."""
    leaf, own = feature < 0, np.arange(len(feature))
    children = np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], axis=1).ravel()
    depth = np.zeros(len(feature), dtype=int)
    level = np.array([0])
    while len(level):
        inner = level[~leaf[level]]
        below = np.concatenate([left[inner], right[inner]])
        depth[below] = np.concatenate([depth[inner], depth[inner]]) + 1
        level = below
    return np.where(leaf, 0, feature).astype(np.int64), cut, children.astype(np.int64), int(depth.max(initial=0)), depth + _expected_path(size)


def _path_lengths(points: np.ndarray, forest: Sequence[tuple], block: int = 4096) -> np.ndarray:
    """The sum over the trees of each point's path length. Points go by in blocks that stay in the cache."""
    total = np.zeros(len(points))
    for start in range(0, len(points), block):
        part = points[start : start + block]
        flat, base = part.ravel(), np.arange(len(part)) * part.shape[1]
        for feature, cut, children, depth, path in forest:
            at = np.zeros(len(part), dtype=np.int64)
            for _ in range(depth):
                at = children.take(2 * at + (flat.take(base + feature.take(at)) < cut.take(at)))
            total[start : start + block] += path.take(at)
    return total


def score_isolation(df: DataFrame, nodes: DataFrame, features: Sequence[str], sample: int = 256,
                    name: str = "score") -> DataFrame:
    """Score −2^(−mean path/c(sample)): higher is more normal. The forest is bounded by its parameters
    (trees·2·sample nodes), so it travels as one broadcast."""
    forest = [t for _, t in nodes.toPandas().sort_values(["tree", "node"]).groupby("tree")]
    packed = [_walkable(*(t[c].to_numpy() for c in ("feature", "cut", "left", "right", "size"))) for t in forest]
    largest = max((int(t["size"].iloc[0]) for t in forest), default=sample)
    shared = df.sparkSession.sparkContext.broadcast(packed)
    norm = float(_expected_path(np.array([largest]))[0]) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        points = np.stack(x.to_numpy()).astype(float)
        total = _path_lengths(points, shared.value)
        return pd.Series(-np.power(2.0, -(total / max(len(shared.value), 1)) / norm))

    return df.withColumn(name, score(F.array(*[F.coalesce(F.col(f), F.lit(0.0)) for f in features])))
