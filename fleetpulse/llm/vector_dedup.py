"""Near-duplicate vectors: passes over orders by concatenated random hashes, bounded windows, links joined across passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import connected_components, drop_tables, settled

PASSES = 16
WINDOW = 48                 # neighbours behind each vector in one order
BITS = 48                   # hash bits of one pass: signs of random projections, concatenated
BLOCK = 1000                # vectors of a component that meet in one task
GROUP = 5000                # vectors of small components that share a task


def _readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, vec: the float64 bytes of a usable vector, else null (null, zero, or with a null or non-finite part)."""
    for batch in batches:
        out = []
        for value, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist()):
            good = None
            if value and label is not None and None not in value:
                v = np.array(value, np.float64)
                if np.isfinite(v).all() and v.any():
                    good = (v + 0.0).tobytes()
            out.append(good)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])


def _matrix(column) -> np.ndarray:
    """Unit vectors as rows, float64. The values are scaled first, so that no square leaves the range."""
    x = np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _orders(passes: int):
    """One row per vector and pass: pass, label, width, signature, rep, vec."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            size = pd.Series([len(v) // 8 for v in batch.column("vec").to_pylist()])
            for width, rows in size.groupby(size).groups.items():
                part = batch.take(pa.array(np.asarray(rows)))
                if width not in planes:
                    planes[width] = np.random.default_rng(3).normal(size=(width, passes * BITS))
                signs = (_matrix(part.column("vec").to_pylist()) @ planes[width] > 0).reshape(len(part), passes, BITS)
                sig = (signs.astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(axis=2)
                for k in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), k, np.int32)), part.column("label"), pa.array(np.full(len(part), width, np.int32)),
                         pa.array(sig[:, k]), part.column("rep"), part.column("vec")], names=["pass", "label", "width", "sig", "rep", "vec"])
    return run


def _windows(least: float, window: int):
    """Over a sorted partition: links of each vector with the next `window` of its pass, label and width, as far as they
    join what was apart in this stretch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = pa.Table.from_batches([batch.slice(at, 4096)])
                old = tail.num_rows if tail is not None else 0
                rows = pa.concat_tables([tail, rows]) if old else rows
                kind = np.stack([rows.column(c).to_numpy() for c in ("pass", "label", "width")], 1)
                rep, vec = rows.column("rep").to_numpy(), rows.column("vec").to_pylist()
                change = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]).any(axis=1), [True])))
                found = []
                for a, b in zip(change[:-1], change[1:]):
                    x = _matrix(vec[a:b])
                    root = np.arange(b - a)
                    for o in range(1, min(window, b - a - 1) + 1):
                        start = max(old - a - o, 0)     # pairs inside the tail were seen before
                        near = start + np.flatnonzero(np.einsum("ij,ij->i", x[start : b - a - o], x[start + o :]) >= least)
                        near = near[root[near] != root[near + o]]
                        for k in near.tolist():
                            p, q = root[k], root[k + o]
                            if p != q:
                                root[root == max(p, q)] = min(p, q)
                                found.append((rep[a + k], rep[a + k + o]))
                if found:
                    u, v = np.array(found, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                tail = rows.slice(max(rows.num_rows - window, 0))
    return run


def _counts(least: float):
    """Links of every vector inside its component, weighted by copies; a task sees two blocks of one large component, or
    several small components whole."""
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        reps, links = [], []
        for _, part in group.groupby(["component", "width"]):
            left, right = part[part["block"] == part["x"]], part[part["block"] == part["y"]]
            a, b = _matrix(left["vec"].tolist()) if len(left) else None, _matrix(right["vec"].tolist()) if len(right) else None
            if a is None or b is None:
                continue
            near = a @ b.T >= least
            if key[1] == key[2]:
                np.fill_diagonal(near, False)
            reps.append(left["rep"].to_numpy())
            links.append(near @ right["n"].to_numpy())
            if key[1] != key[2]:
                reps.append(right["rep"].to_numpy())
                links.append(left["n"].to_numpy() @ near)
        return pd.DataFrame({"rep": np.concatenate(reps or [np.zeros(0, np.int64)]), "links": np.concatenate(links or [np.zeros(0, np.int64)])})
    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Equal vectors of a label are one class with its number of copies. In each pass the classes are range-partitioned by
    label and signature and every one is compared with its next `window` neighbours, by cosine in double precision; links
    of all passes make the components. Then every component is compared whole, in blocks, so n_links counts every
    other vector of the component at `least` or more, however dense it is. What can be lost is a link between two
    components that no pass brought together (recall is measured in the tests and README).

    Unusable vectors (null, empty, zero, a null or non-finite part) and null labels link with nothing; vectors of other
    lengths do not compare. Rows with a null vec_id stay single: component_id null, kept true. Repeated rows are copies.
    Other columns are ignored; an empty table gives an empty result.
    """
    own: list[str] = []
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    rows = settled(slim.mapInArrow(_readable, "vec_id long, label long, vec binary"), "vectors")
    usable = rows.where("vec is not null and vec_id is not null")
    classes = settled(usable.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    orders = classes.mapInArrow(_orders(passes), "pass int, label long, width int, sig long, rep long, vec binary")
    orders = orders.repartitionByRange("pass", "label", "width", "sig", "rep").sortWithinPartitions("pass", "label", "width", "sig", "rep")
    links = settled(orders.mapInArrow(_windows(least, window), "u long, v long").distinct(), "links", own)
    comps = connected_components(links, own)

    sizes = comps.groupBy("component").agg(F.count("*").alias("size"))
    inside = classes.join(comps.withColumnRenamed("node", "rep"), "rep").join(sizes, "component")
    small = sizes.where(F.col("size") <= BLOCK).agg(F.sum("size")).first()[0] or 0
    groups = max(int(small // GROUP), 1)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    inside = inside.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    inside = inside.select(F.when(blocks > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(groups))).alias("task"),
                           F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "component",
                           (F.octet_length("vec") / 8).cast("int").alias("width"), "rep", "n", "vec")
    links = inside.groupBy("task", "x", "y").applyInPandas(_counts(least), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    known = settled(known.select("label", "vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                                 F.coalesce("component", "rep").alias("component_id")), "known")
    drop_tables(vectors.sparkSession, own)
    out = rows.join(known, ["label", "vec"], "left")
    alone = F.col("n_links").isNull() | F.col("vec_id").isNull()
    out = out.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
                     F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
