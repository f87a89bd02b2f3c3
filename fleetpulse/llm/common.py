"""Shared helpers: scratch tables, Arrow batches cut by bytes, byte-level word hashes, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import ctypes.util
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.session import scratch_path

SLICE_BYTES = 1 << 20


@functools.cache
def _libc_trim():
    name = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None


def _trim() -> None:
    """Garbage collection, then Arrow's pool and glibc's malloc_trim where the C library has it (looked up once in each worker)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = _libc_trim()
    if trim is not None:
        trim(0)


def released(fn):
    """The Arrow-batch function `fn`, which hands freed heap back to the system when its partition ends.

    Python workers are reused from stage to stage; without this, each keeps the high-water mark of the largest batch
    any earlier stage gave it (glibc keeps freed blocks below its raised mmap threshold). A system without
    `malloc_trim` only collects garbage.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _trim()
    return run


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20       # of rows sent to Python at once; Spark's own bound is 64 MB in each running task, on both sides


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this is open, Arrow batches of the session's queries hold about BATCH_BYTES, or less where less is set."""
    before = spark.conf.get(ARROW_BYTES)
    size = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before))
    if 0 < size <= BATCH_BYTES:
        yield
        return
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def settled(df: DataFrame, name: str, keep: list | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage is cut and lost executors cost no recomputation.

    Python workers get its rows in small batches, so that memory does not follow the width of texts. The path is
    appended to `keep`, so that the caller can drop the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables through the file system that holds them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    paths.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece have about `limit` bytes; a longer text stands alone."""
    for batch in batches:
        _, offsets = text_buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of a partition sorted by `keys` (no nulls), cut so that each holds whole groups."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        new = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            values = batch.column(key).to_numpy()
            new |= values[1:] != values[:-1]
        cuts = np.flatnonzero(new)
        last = int(cuts[-1]) + 1 if len(cuts) else 0
        if last:
            yield batch.slice(0, last)
        held = batch.slice(last)
    if held is not None:
        yield held


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]


KEEP_POWERS = 1 << 21   # tables kept for the worker's life: 2 × 16 MB; longer texts get their own, dropped after use


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    made = []
    for base in (_STEP, _BACK):
        full = np.full(n, base, np.uint64)
        full[0] = 1
        made.append(np.multiply.accumulate(full))
    if n <= KEEP_POWERS:
        _POWERS[:] = made
    return made[0], made[1]


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are the longest runs without ASCII white space (or the bytes marked in `space`) inside a text: their starts,
    ends and first word of each text."""
    solid = ~space[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(raw) else solid
    after = np.concatenate((solid[1:], [False])) if len(raw) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, A-Z as a-z, from one running sum of weighted bytes."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words.

    A text with fewer words gives its whole word sequence as one element, a text without words the empty set.
    """
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    runs = max(len(words) - width + 1, 0)
    joined = np.zeros(runs, np.uint64)
    for k in range(width):
        joined += words[k : k + runs] * factors[k]
    joined = mix(joined)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            own = np.sort(joined[a : b - width + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            yield mix(np.array([(words[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


FILTER_BITS = 1 << 25       # 4 MB whatever the number of ids


def _bits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two positions of each id in the filter, as word numbers and bits in the word."""
    at = np.concatenate([mix(ids.view(np.uint64) + np.uint64(k)) for k in (11, 29)]) & np.uint64(FILTER_BITS - 1)
    return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def member_sides(rows: DataFrame, ids: DataFrame, column: str):
    """`side(True)` are the rows that may be among the ids, `side(False)` those that cannot be."""
    spark = rows.sparkSession

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bit = _bits(batch.column(0).drop_null().to_numpy())
            order = np.argsort(word, kind="stable")
            word, bit = word[order], bit[order]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, int)
            bit = np.bitwise_or.reduceat(bit, first) if len(word) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(bit.view(np.int64))], names=["word", "bits"])

    got = ids.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    full = np.zeros(FILTER_BITS // 64, np.uint64)
    full[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(full)

    def side(inside: bool) -> DataFrame:
        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(column)
                word, bit = _bits(values.fill_null(0).to_numpy(zero_copy_only=False))
                hit = ((sent.value[word] & bit) != 0).reshape(2, -1).all(axis=0) & values.is_valid().to_numpy(zero_copy_only=False)
                if (hit == inside).any():
                    yield batch.filter(pa.array(hit == inside))
        return rows.mapInArrow(passing, rows.schema)

    return side


def only_members(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` (long) is in the one-column table `ids`; other rows hardly enter the shuffle.

    A filter of fixed size (FILTER_BITS) is made from the ids in Spark and sent to the tasks; what passes it by chance
    falls out in the join behind it. With very many ids it fills up and only the join works.
    """
    ids = ids.withColumnRenamed(ids.columns[0], column)
    return member_sides(rows, ids, column)(True).join(ids.distinct(), column, "left_semi").select(*rows.columns)


def without_members(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` (long) is null or not in `ids`; only those that the filter holds for possible enter the shuffle."""
    ids = ids.withColumnRenamed(ids.columns[0], column)
    side = member_sides(rows, ids, column)
    return side(False).union(side(True).join(ids.distinct(), column, "left_anti").select(*rows.columns))


BROADCAST_IDS = 4_000_000   # some 32 MB of longs: above it the ids are shuffled beside the rows


def without_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` is null or not among `ids` (a one-column table), all in the JVM.

    The ids are counted first: up to BROADCAST_IDS distinct ones are sent to every task, more go by a shuffle join. Rows
    never pass through Python, whatever their width. Repeated ids and an empty id table are fine.
    """
    ids = ids.select(F.col(ids.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct()
    ids = settled(ids, "ids")
    small = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, column, "left_anti").select(*rows.columns)


def connected_components(edges: DataFrame, keep: list | None = None, max_rounds: int = 60) -> DataFrame:
    """Alternate large-star and small-star until the edges stand still; (u, v) longs → one (node, component) row per node.

    The component is its smallest node. Both steps are a combined minimum per node and a join, so a node with very
    many edges is spread by the skew join. Self loops, repeated edges and an empty table are fine.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null")
    loops = edges.select(F.col("u").alias("node")).union(edges.select("v"))
    own: list[str] = []
    nodes = settled(loops.distinct(), "nodes", own)
    now = settled(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", own)
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        small = small.select("e.*").where("u <> v").distinct()
        now = settled(small, "edges", own)
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = nodes.join(now.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node"), "node", "left")
    out = settled(out.select("node", F.coalesce("m", "node").alias("component")), "components", keep)
    drop_tables(spark, own)
    return out


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
