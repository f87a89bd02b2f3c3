"""Exact k-nearest-neighbour search and classification by blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from fleetpulse.session import written

BLOCK_ROWS = 16_384
GRID = 8              # blocks of train rows up to which every query meets every block
QUERIES = 65_536      # queries of a task
AT_ONCE = 4_000_000   # numbers of a scratch array of a task


def _exact(ids, points, x, k: int):
    """The k best (distance, id) of one query by plain differences; also right for NaN, which sorts last."""
    d = np.sqrt(((points - x) ** 2).sum(axis=1))
    best = np.lexsort((ids, d))[:k]
    return ids[best], d[best]


def _fewest_copies(ids, points, k: int):
    """Of rows with the same vector only the k smallest ids can be among the k nearest."""
    order = np.lexsort((ids,))
    ids, points = ids[order], np.ascontiguousarray(points[order])
    same = np.unique(points, axis=0, return_inverse=True)[1].ravel()
    by_vector = np.argsort(same, kind="stable")
    ends = np.flatnonzero(np.diff(same[by_vector])) + 1
    first = np.repeat(np.r_[0, ends], np.diff(np.r_[0, ends, len(ids)]))
    kept = np.sort(by_vector[np.arange(len(ids)) - first < k])
    return ids[kept], points[kept]


def _nearest(ids, points, queries, k: int):
    """(query row, id, distance) of the k nearest points of every query, ties by id.

    |t|² − 2·q·t from one matrix product orders the points up to rounding. The k-th smallest of the minima of disjoint
    groups bounds the k-th smallest number; whatever lies below the bound plus the rounding error is measured exactly.
    """
    whole = np.isfinite(points).all(axis=1)
    if whole.sum() < k or np.abs(points[whole]).max() > 1e100:
        odd = np.arange(len(queries))
    else:
        odd = np.flatnonzero(~(np.abs(queries) <= 1e100).all(axis=1))
    out = []
    for i in odd:
        best, d = _exact(ids, points, queries[i], k)
        out.append((np.full(len(best), i), best, d))
    plain = np.setdiff1d(np.arange(len(queries)), odd)
    if not len(plain):
        return out
    ids, points = _fewest_copies(ids[whole], points[whole], k)
    n, width = points.shape
    groups = min(max(n // 32, 8 * k), n)
    rows_a_group = n // groups
    squares = (points ** 2).sum(axis=1)
    slack = 8.0 * (width + 8) * np.finfo(float).eps
    turned = np.ascontiguousarray(points.T) * -2.0
    step = max(1, AT_ONCE // n)
    for start in range(0, len(plain), step):
        part = plain[start:start + step]
        q = queries[part]
        rest = q @ turned
        rest += squares
        least = rest[:, :groups * rows_a_group].reshape(len(part), rows_a_group, groups).min(axis=1)
        bound = np.partition(least, k - 1, axis=1)[:, k - 1] if groups > k else least.max(axis=1)
        bound += slack * ((q ** 2).sum(axis=1) + squares.max())
        place = np.flatnonzero(rest <= bound[:, None])
        row, col = np.divmod(place, n)
        d = np.empty(len(place))
        for at in range(0, len(place), max(1, AT_ONCE // width)):
            piece = slice(at, at + max(1, AT_ONCE // width))
            d[piece] = np.sqrt(((points[col[piece]] - q[row[piece]]) ** 2).sum(axis=1))
        order = np.lexsort((ids[col], d, row))
        row, col, d = row[order], col[order], d[order]
        first = np.searchsorted(row, row)
        best = np.arange(len(row)) - first < k
        out.append((part[row[best]], ids[col[best]], d[best]))
    return out


def knn_join(train: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 7,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest train rows of every query, ties by neighbour id.

    Both sides are hashed into blocks of about `block_rows` rows; each pair of blocks is one
    small group that emits its own k best per query, never the pairs themselves. Memory per
    task is bounded by the block size, the exchange by rows × blocks of the other side.
    Beyond `GRID` blocks of train rows these are cut by place instead (`_by_place`), so that a query meets few of them.
    Exact search costs |train|·|queries| numbers of a matrix product; `approximate_knn` avoids that.
    """
    n_train, n_query = train.count(), queries.count()
    bt, bq = max(1, math.ceil(n_train / block_rows)), max(1, math.ceil(n_query / block_rows))
    # enough pairs of blocks for every core where the work is worth it
    cores = train.sparkSession.sparkContext.defaultParallelism
    bq = max(bq, min(math.ceil(4 * cores / bt), math.ceil(n_train * n_query / bt / 5e7)))
    single = all(d.schema[vector].dataType.elementType == FloatType() for d in (train, queries))   # widened in the task
    vec = (F.col(vector) if single else F.transform(F.col(vector), lambda x: x.cast("double"))).alias("v")
    w = W.partitionBy("query").orderBy("distance", "neighbour")
    if bt > GRID:
        plain = lambda d: d.select(F.col(key).cast("long").alias("id"), vec)
        found = _by_place(plain(train), plain(queries), k, n_train, block_rows)
        w = W.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), "neighbour")   # NaN comes as null
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    home = lambda n, salt: F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(n)).cast("int")
    t = train.select(F.col(key).cast("long").alias("id"), vec, home(bt, 1).alias("tb"),
                     F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("qb"))
    q = queries.select(F.col(key).cast("long").alias("id"), vec, home(bq, 2).alias("qb"),
                       F.explode(F.sequence(F.lit(0), F.lit(bt - 1))).alias("tb"))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "neighbour": [], "distance": []})
        points, targets = (np.stack(side["v"].to_numpy()).astype(float) for side in (left, right))
        found = _nearest(left["id"].to_numpy(), points, targets, k)
        row, ids, d = (np.concatenate(parts) for parts in zip(*found))
        return pd.DataFrame({"query": right["id"].to_numpy()[row], "neighbour": ids, "distance": d})

    cells = t.groupBy("tb", "qb").cogroup(q.groupBy("tb", "qb")).applyInPandas(
        nearest, "query long, neighbour long, distance double")
    return cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


class _Places:
    """Space halved `depth` times, each time at the median of a sample in its widest direction, and the boxes of the rows found there.

    The sample only places the cuts: rows are compared with the boxes of all rows.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, size = depth, (1 << depth) - 1
        self.dims, self.cuts = np.zeros(size, int), np.zeros(size)
        parts = {0: sample}
        for node in range(size):
            part = parts.pop(node)
            if len(part):
                dim = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                x = np.sort(part[:, dim])
                cut = x[(len(x) - 1) // 2]
                below = x[x < cut]
                if len(below) and abs((x <= cut).sum() - len(x) / 2) > abs(len(below) - len(x) / 2):
                    cut = below[-1]     # many equal values: the more even side to cut
                self.dims[node], self.cuts[node] = dim, cut
            right = part[:, self.dims[node]] > self.cuts[node]
            parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]

    def of(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.dims[node]] > self.cuts[node])
        return node - len(self.dims)

    def boxed(self, parts: list) -> None:
        """Boxes and counts from (place, n, low, high) of many tasks; places that are too full are dealt into several cells."""
        n, width = 1 << self.depth, len(parts[0][2])
        self.n, self.low, self.high = np.zeros(n, int), np.full((n, width), np.inf), np.full((n, width), -np.inf)
        for at, count, low, high in parts:
            self.n[at] += count
            self.low[at], self.high[at] = np.minimum(self.low[at], low), np.maximum(self.high[at], high)

    def dealt(self, rows: int) -> None:
        self.cells = -(-self.n // rows)                        # cells of a place; none where no row is
        self.first = np.r_[0, np.cumsum(self.cells)[:-1]]
        self.place = np.repeat(np.arange(len(self.n)), self.cells)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """No row of a place is nearer than this (query, place); NaN for odd queries, infinite where there are no finite rows."""
        out = np.empty((len(x), len(self.n)))
        step = max(1, AT_ONCE // self.low.size)
        for at in range(0, len(x), step):
            q = x[at:at + step, None, :]
            out[at:at + step] = np.sqrt((np.maximum(np.maximum(self.low - q, q - self.high), 0.0) ** 2).sum(axis=2))
        return out


def _by_place(train: DataFrame, queries: DataFrame, k: int, n_train: int, block_rows: int) -> DataFrame:
    """(query, neighbour, distance) that hold the k nearest of every query, for many train rows.

    Train rows are cut into compact cells. A query is first compared with the cell it lies nearest to; the k-th distance found
    there bounds the answer, so afterwards it only goes to cells whose box is not farther away. The exchange is the train rows
    and queries twice plus a query for every further cell within its bound; cells take as many rows as a task can hold, so
    that vectors that no box tells apart are sent to few cells.
    """
    spark = train.sparkSession
    chosen = train.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(max(1, n_train // 20_000))) == 0).select("v").limit(40_000).toArrow()["v"]
    sample = _matrix(chosen.combine_chunks(), len(chosen)) if len(chosen) else _matrix(train.select("v").limit(1).toArrow()["v"].combine_chunks(), 1)
    width = sample.shape[1]
    rows = max(block_rows, min(n_train // 64, 16 * block_rows, (64 << 20) // (8 * width)))
    places = _Places(sample[np.isfinite(sample).all(axis=1)], max(1, math.ceil(math.log2(n_train / rows))))

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Places.__new__(_Places)
        task.depth = places.depth
        task.boxed([(0, 0, np.full(width, np.inf), np.full(width, -np.inf))])
        for batch in batches:
            x = _matrix(batch.column("v"), batch.num_rows)
            at, whole = places.of(x), np.isfinite(x).all(axis=1)
            for i in np.unique(at):
                own = x[(at == i) & whole]
                task.n[i] += (at == i).sum()
                if len(own):
                    task.low[i], task.high[i] = np.minimum(task.low[i], own.min(axis=0)), np.maximum(task.high[i], own.max(axis=0))
        some = np.flatnonzero(task.n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(task.n[some]), *(pa.array(list(side[some]), pa.list_(pa.float64()))
                                                                                    for side in (task.low, task.high))], names=["at", "n", "low", "high"])

    found = train.mapInArrow(boxes, "at long, n long, low array<double>, high array<double>").collect()
    places.boxed([(r["at"], r["n"], np.array(r["low"]), np.array(r["high"])) for r in found])
    places.dealt(2 * rows)
    vector = train.schema["v"].dataType.simpleString()

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places.of(_matrix(batch.column("v"), batch.num_rows))
            turn = np.arange(batch.num_rows) % places.cells[at]      # any deal will do
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((places.first[at] + turn).astype(np.int32))], names=["id", "v", "cell"])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(places.n)
        for batch in batches:
            d = places.distances(_matrix(batch.column("v"), batch.num_rows))[:, some]
            near = some[np.where(np.isnan(d), np.inf, d).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places.first[near].astype(np.int32))], names=["id", "v", "cell"])

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = places.distances(_matrix(batch.column("v"), batch.num_rows))[:, places.place]
            bound = np.array([ds[-1] if len(ds) == k and ds[-1] is not None else np.inf for ds in batch.column("ds").to_pylist()])   # NaN came as null
            go = (d * (1 - 1e-9) <= bound[:, None]) | np.isinf(bound)[:, None]
            go[np.arange(len(go)), batch.column("cell").to_numpy()] = False
            row, cell = np.nonzero(go)
            for at in range(0, len(row), 50_000):
                part = slice(at, at + 50_000)
                taken = pa.array(row[part])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(taken), batch.column("v").take(taken), pa.array(cell[part].astype(np.int32)),
                                                  pa.array(bound[row[part]])], names=["id", "v", "cell", "bound"])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, ...]:
        points, targets = (np.stack(side["v"].to_numpy()).astype(float) for side in (left, right))
        row, ids, d = (np.concatenate(parts) for parts in zip(*_nearest(left["id"].to_numpy(), points, targets, k)))
        return row, ids, d

    def at_home(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return pd.DataFrame({"id": [], "v": [], "cell": [], "ids": [], "ds": []})
        row, ids, d = best(left, right)
        order = np.lexsort((ids, d, row))
        ends = np.cumsum(np.bincount(row, minlength=len(right)))[:-1]
        return right[["id", "v", "cell"]].assign(ids=np.split(ids[order], ends), ds=np.split(d[order], ends))

    def elsewhere(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return pd.DataFrame({"query": [], "neighbour": [], "distance": []})
        row, ids, d = best(left, right)
        near = ~(d > right["bound"].to_numpy()[row])
        return pd.DataFrame({"query": right["id"].to_numpy()[row[near]], "neighbour": ids[near], "distance": d[near]})

    def met(asked: DataFrame, fn, schema: str) -> DataFrame:
        """Cells with many queries are sent to several tasks."""
        counts = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
        pieces = F.get(F.array(*[F.lit(math.ceil(counts.get(c, 0) / QUERIES)) for c in range(len(places.place))]), F.col("cell"))
        t = train.mapInArrow(celled, f"id long, v {vector}, cell int").where(pieces > 0).withColumn(
            "piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        q = asked.withColumn("piece", F.pmod(F.xxhash64("id", "v"), pieces).cast("int"))
        return t.groupBy("cell", "piece").cogroup(q.groupBy("cell", "piece")).applyInPandas(fn, schema)

    asked = queries.mapInArrow(home, f"id long, v {vector}, cell int")
    begun = written(met(asked, at_home, f"id long, v {vector}, cell int, ids array<long>, ds array<double>"), "neighbours")
    rest = met(begun.select("id", "v", "cell", "ds").mapInArrow(further, f"id long, v {vector}, cell int, bound double"), elsewhere,
               "query long, neighbour long, distance double")
    first = begun.select(F.col("id").alias("query"), F.inline(F.arrays_zip(F.col("ids").alias("neighbour"), F.col("ds").alias("distance"))))
    return first.select("query", "neighbour", "distance").unionByName(rest)


def approximate_knn(train: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 7, radius: float = 1.0,
                    bucket: float = 2.0, tables: int = 4, seed: int = 42) -> DataFrame:
    """The same by locality-sensitive hashing: neighbours within `radius` that share a bucket. For large tables."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    shaped = lambda d: d.select(F.col(key).cast("long").alias("id"), array_to_vector(
        F.transform(F.col(vector), lambda x: x.cast("double"))).alias("v"))
    t = shaped(train)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(t)
    pairs = model.approxSimilarityJoin(t, shaped(queries), radius, "distance").select(
        F.col("datasetB.id").alias("query"), F.col("datasetA.id").alias("neighbour"), "distance")
    w = W.partitionBy("query").orderBy("distance", "neighbour")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_classify(neighbours: DataFrame, labels: DataFrame, key: str, label: str, weighted: bool = True) -> DataFrame:
    """(query, class, p): neighbours vote by 1/distance; exact matches, if any, take the whole vote."""
    named = neighbours.join(labels.select(F.col(key).cast("long").alias("neighbour"), F.col(label).alias("class")), "neighbour")
    per_query = W.partitionBy("query")
    exact = F.max(F.when(F.col("distance") == 0, 1).otherwise(0)).over(per_query) == 1
    vote = F.when(exact, F.when(F.col("distance") == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    if not weighted:
        vote = F.lit(1.0)
    votes = named.withColumn("__v", vote).groupBy("query", "class").agg(F.sum("__v").alias("__v"))
    return votes.select("query", "class", (F.col("__v") / F.sum("__v").over(per_query)).alias("p")).where("p > 0")

