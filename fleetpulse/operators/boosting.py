"""Many-class gradient boosting: second-order steps on softmax gradients over binned features, one tree per class and round.

No one-vs-rest: every round takes p = softmax(margins) of all classes, g = w (p_k - y_k), h = w p_k (1 - p_k), and grows
one tree per class on (g, h). Trees grow level by level; a level of all K trees is one pass over the rows, in which
every task sums the gradient histograms of its rows per (class, open node, feature, bin) with numpy. While the tasks' sums
are small together they go to the driver at once, else Spark sums them by node and the tasks choose the splits, so that only
those reach the driver. Splits have the usual gain G_L²/(H_L+λ) + G_R²/(H_R+λ) − G²/(H+λ).

Rows are kept as blocks of arrays with their margins, which each round's trees move on; every `refresh` rounds they are
written to the shared folder (lineage cut, lost executors cost at most `refresh` rounds). A pass is one job over the blocks,
planned once a refresh: hundreds of rounds make thousands of passes.
Feature bins are quantiles of each feature (approxQuantile, at most `bins` − 1 edges a feature).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from fleetpulse.session import scratch_path

AT_ONCE = 32 << 20   # bytes of the tasks' histograms that the driver takes in one pass
TASK_ROWS = 20_000


@dataclass
class Tree:
    """A complete binary tree in arrays: node i has children 2i+1, 2i+2; feature −1 marks a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        size = (1 << (depth + 1)) - 1
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size))

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[node]
            go = f >= 0
            if not go.any():
                break
            right = bins[rows, np.maximum(f, 0)] > self.threshold[node]
            node = np.where(go, 2 * node + 1 + right, node)
        return node

    def predict(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return self.value[self.nodes(bins, depth)]


def _softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _advanced(block: bytes, trees: list[Tree], depth: int) -> bytes:
    """The block with a round's trees added to its margins."""
    bins, label, weight, margins = pickle.loads(block)
    margins = margins + np.stack([t.predict(bins, depth) for t in trees], axis=1)
    return pickle.dumps((bins, label, weight, margins), 5)


def _best_splits(sums: np.ndarray, l2: float, least: float) -> np.ndarray:
    """(feature, bin, gain, G_L, H_L, G, H) of the best split of every node from its (2, node, feature, bin) sums."""
    G, H = sums
    gt, ht = G[:, 0].sum(axis=1), H[:, 0].sum(axis=1)
    gl, hl = np.cumsum(G, axis=2)[:, :, :-1], np.cumsum(H, axis=2)[:, :, :-1]
    gr, hr = gt[:, None, None] - gl, ht[:, None, None] - hl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - (gt ** 2 / (ht + l2))[:, None, None]
    gain = np.where((hl >= least) & (hr >= least) & (ht > 0)[:, None, None], gain, -np.inf).reshape(len(G), -1)
    best, at = gain.argmax(axis=1), np.arange(len(G))
    f, b = np.divmod(best, gl.shape[2])
    return np.stack([f, b, gain[at, best], gl[at, f, b], hl[at, f, b], gt, ht], axis=1)


@dataclass
class SoftmaxBoostModel:
    trees: list[list[Tree]]                 # per round, one tree per class
    edges: list[np.ndarray]
    depth: int
    n_classes: int
    features_col: str = "features"
    extra: dict = field(default_factory=dict)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = _binned(x, self.edges)
        out = np.zeros((len(x), self.n_classes))
        for round_trees in self.trees:
            for c, tree in enumerate(round_trees):
                out[:, c] += tree.predict(bins, self.depth)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `probs` (softmax of the summed margins) and `prediction` (the likeliest class); rows keep their columns."""
        model = df.sparkSession.sparkContext.broadcast(self)        # bounded: rounds × classes × 2^(depth+1) nodes
        col = "__x"
        names = df.columns
        k = self.n_classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = pc.list_flatten(batch.column(col)).to_numpy(zero_copy_only=False)
                x = x.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(model.value.edges)))
                p = _softmax(model.value.margins(x)) if batch.num_rows else np.zeros((0, k))
                probs = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), k).cast(pa.list_(pa.float64()))
                cols = [batch.column(n) for n in names] + [probs, pa.array(p.argmax(axis=1).astype(np.float64))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "probs", "prediction"])

        schema = df.select(*names).schema.add("probs", ArrayType(DoubleType())).add("prediction", DoubleType())
        return df.withColumn(col, vector_to_array(self.features_col)).mapInArrow(run, schema)


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many edges lie below it (NaN: the last bin)."""
    out = np.empty(x.shape, np.uint8)
    for f, e in enumerate(edges):
        col = x[:, f]
        b = np.searchsorted(e, col, side="left")
        out[:, f] = np.where(np.isnan(col), len(e), b)
    return out


class SoftmaxBoost:
    """fit(df) on `features` (vector), `label_index` and, if given, `weight`; see the module docstring."""

    def __init__(self, maxIter: int = 300, stepSize: float = 0.05, maxDepth: int = 6, bins: int = 32, l2: float = 1.0,
                 minChildWeight: float = 1e-3, weightCol: str | None = None, labelCol: str = "label_index",
                 featuresCol: str = "features", refresh: int = 10, **ignored):
        if not 2 <= bins <= 256:
            raise ValueError("bins must be 2 … 256")
        self.rounds, self.rate, self.depth, self.bins, self.l2 = maxIter, stepSize, maxDepth, bins, l2
        self.min_child, self.weight, self.label, self.features, self.refresh = minChildWeight, weightCol, labelCol, featuresCol, refresh
        self.ignored = ignored

    def fit(self, df: DataFrame, edges: list | None = None) -> SoftmaxBoostModel:
        """Trees on `df`; `edges` (per feature, ascending) replace the quantile edges where given."""
        spark = df.sparkSession
        arr = vector_to_array(self.features)
        n_features = len(df.select(self.features).first()[0]) if not df.isEmpty() else 0
        last, n = df.agg(F.max(self.label), F.count(F.lit(1))).first()
        k = int(last) + 1
        cols = [arr[i].alias(f"f{i}") for i in range(n_features)]
        wide = df.select(*cols)
        probs = [j / self.bins for j in range(1, self.bins)]
        if edges is None:
            quantiles = wide.approxQuantile([f"f{i}" for i in range(n_features)], probs, 0.001)   # F × (bins − 1) numbers
            edges = [np.unique(np.asarray(q, float)) for q in quantiles]
        edges = [np.asarray(e, float)[:self.bins - 1] for e in edges]
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = df.select(arr.alias("x"), F.col(self.label).cast("int").alias("label"), weight.alias("weight"))
        sent_edges = spark.sparkContext.broadcast(edges)

        def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                b = _binned(x, sent_edges.value)
                label, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight"))
                block = pickle.dumps((b, label, weight, np.zeros((batch.num_rows, k))), 5)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

        paths: list[str] = []
        table = rows.mapInArrow(prepare, "block binary").coalesce(max(1, n // TASK_ROWS))   # a small table is not worth many tasks a pass
        blocks = self._write(table, paths)
        model = SoftmaxBoostModel([], edges, self.depth, k, self.features)
        before = None
        for r in range(self.rounds):
            trees = self._round(blocks, n_features, k)
            model.trees.append(trees)
            if before is not None:   # the first pass of the round has kept the blocks that follow
                before.unpersist()
            if r + 1 < self.rounds:
                before, blocks = blocks, blocks.map(lambda block, trees=trees, depth=self.depth: _advanced(block, trees, depth))
                if (r + 1) % self.refresh == 0:
                    blocks = self._write(spark.createDataFrame(blocks.map(lambda block: (block,)), "block binary"), paths)
                else:
                    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        blocks.unpersist()
        self._drop(spark, paths)
        return model

    def _write(self, df: DataFrame, paths: list[str]) -> RDD:
        spark = df.sparkSession
        path = scratch_path(spark, "boost-rows")
        df.write.parquet(path)
        self._drop(spark, paths)
        paths.append(path)
        return spark.read.parquet(path).rdd.map(lambda row: row[0]).persist(StorageLevel.MEMORY_AND_DISK)

    @staticmethod
    def _drop(spark, paths: list[str]) -> None:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            where = jvm.org.apache.hadoop.fs.Path(p)
            where.getFileSystem(conf).delete(where, True)
        paths.clear()

    def _round(self, blocks: RDD, n_features: int, k: int) -> list[Tree]:
        """One tree per class, grown level by level; each level is one pass."""
        trees = [Tree.empty(self.depth) for _ in range(k)]
        opened = [(c, 0) for c in range(k)]
        B, depth, lam, least = self.bins, self.depth, self.l2, self.min_child
        for level in range(depth):
            width = 1 << level
            slots = np.full((k, width), -1)         # place of an open node among the sums
            for i, (c, node) in enumerate(opened):
                slots[c, node - width + 1] = i

            def run(part: Iterator[bytes], trees=trees, slots=slots, n=len(opened), first=width - 1) -> Iterator[np.ndarray]:
                sums, seen = np.zeros((2, n, n_features, B)), False
                for block in part:
                    seen = True
                    bins, label, weight, margins = pickle.loads(block)
                    p = _softmax(margins)
                    y = np.zeros_like(p)
                    y[np.arange(len(p)), label] = 1.0
                    g = weight[:, None] * (p - y)
                    h = weight[:, None] * np.maximum(p * (1 - p), 1e-16)
                    for c in np.flatnonzero((slots >= 0).any(axis=1)):
                        own = slots[c][slots[c] >= 0]
                        at = trees[c].nodes(bins, depth) - first
                        at = np.where(at >= 0, slots[c][at], -1)
                        live = np.flatnonzero(at >= 0)
                        low, here = own.min(), (own.max() - own.min() + 1) * B     # a class's nodes are neighbours
                        base, gc, hc = (at[live] - low) * B, g[live, c], h[live, c]
                        for f in range(n_features):
                            keys = base + bins[live, f]
                            for side, values in enumerate((gc, hc)):
                                sums[side, low:low + here // B, f] += np.bincount(keys, values, here).reshape(-1, B)
                if seen:
                    yield sums

            parts = blocks.mapPartitions(run)
            if blocks.getNumPartitions() * 16 * len(opened) * n_features * B <= AT_ONCE:
                splits = _best_splits(sum(parts.collect()), lam, least)
            else:
                by_node = parts.flatMap(lambda sums: ((i, sums[:, i]) for i in range(sums.shape[1]))).reduceByKey(lambda a, b: a + b)
                found = by_node.mapValues(lambda sums: _best_splits(sums[:, None], lam, least)[0]).collect()
                splits = np.stack([split for _, split in sorted(found, key=lambda pair: pair[0])])
            grown = []
            for (c, node), (f, b, gain, gl, hl, gt, ht) in zip(opened, splits):
                if level == 0:
                    trees[c].value[node] = -self.rate * gt / (ht + lam)
                if gain > 1e-12:
                    trees[c].feature[node], trees[c].threshold[node] = f, b
                    trees[c].value[2 * node + 1] = -self.rate * gl / (hl + lam)
                    trees[c].value[2 * node + 2] = -self.rate * (gt - gl) / (ht - hl + lam)
                    grown += [(c, 2 * node + 1), (c, 2 * node + 2)]
            opened = grown
            if not opened:
                break
        return trees
