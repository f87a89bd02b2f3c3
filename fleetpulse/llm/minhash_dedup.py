"""Near-duplicate documents: minima of universal hashes, banding, signature and exact verification, star components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import by_bytes, connected_components, drop_tables, mix, only_members, settled, shingle_sets, text_buffers, released, whole_groups

BLOCK = 1500                 # members of a bucket that meet in one task
PAIRS = 1 << 18              # pairs that are compared at once
SLICE = 1 << 18              # bytes of text hashed at once


class Scheme:
    """`bands` × `rows` universal hashes a·x + b mod 2^32 over mixed 64-bit shingle hashes.

    A pair of similarity j shares no band with a chance of (1 - j^rows)^bands. The signature has one bit per minimum, from
    a random table per hash: equal minima agree and others agree with a chance of 1/2, whatever the elements behind them.
    `differ` is the number of bits by which a pair of the least similarity differs, and 4.6 standard deviations more.
    """

    def __init__(self, bands: int = 40, rows: int = 6, similarity: float = 0.8):
        self.bands, self.rows, self.n = bands, rows, bands * rows
        unlike = (1 - similarity) / 2
        self.differ = self.n * unlike + 4.6 * (self.n * unlike * (1 - unlike)) ** 0.5
        draw = np.random.default_rng(7)
        self.a = draw.integers(0, 1 << 32, self.n, dtype=np.uint32) | np.uint32(1)
        self.b = draw.integers(0, 1 << 32, self.n, dtype=np.uint32)
        self.chosen = draw.integers(0, 2, (self.n, 256), dtype=np.uint8)

    def minima(self, own: np.ndarray) -> np.ndarray:
        """The smallest value of each hash over the set."""
        x = (own >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.n, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            part = np.multiply.outer(self.a, x[at : at + 2048])
            part += self.b[:, None]
            np.minimum(out, part.min(axis=1), out=out)
        return out

    def all_minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of minima per set, none of them empty; small sets are taken together."""
        out = np.empty((len(sets), self.n), np.uint32)
        total = np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))
        start = 0
        while start < len(sets):
            stop = int(np.searchsorted(total, total[start] + 2048, "right")) - 1
            if stop <= start:
                stop = start + 1
                out[start] = self.minima(sets[start])
            else:
                x = (np.concatenate(sets[start:stop]) >> np.uint64(32)).astype(np.uint32)
                part = np.multiply.outer(self.a, x)
                part += self.b[:, None]
                out[start:stop] = np.minimum.reduceat(part, total[start:stop] - total[start], axis=1).T
            start = stop
        return out

    def signature(self, low: np.ndarray) -> np.ndarray:
        """Rows of minima → rows of 64-bit words with one bit per minimum."""
        packed = np.packbits(self.chosen[np.arange(self.n), low & np.uint32(255)], axis=1)
        return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)

    def keys(self, low: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; the band's number is part of it."""
        rows = low.reshape(self.bands, self.rows).astype(np.uint64)
        key = mix(np.arange(1, self.bands + 1, dtype=np.uint64))
        for k in range(self.rows):
            key = mix(key ^ rows[:, k]) + np.uint64(k)
        return key.view(np.int64)


def _keys(own: np.ndarray, low: np.ndarray, scheme: Scheme, percent: int, short: int) -> np.ndarray:
    """Bucket keys of a set. Of two sets of m elements or more that are alike, each has one of the common ones among its
    m - ceil(m·percent/100) + 1 smallest: keys without a chance of loss for sets of up to `short`, band keys beyond.
    Sets that may be alike across that border have both."""
    m, keys = len(own), []
    if m * percent <= short * 100:
        keys.append(mix(own[: m + (-percent * m // 100) + 1] ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64))
    if m > short:
        keys.append(scheme.keys(low))
    return np.concatenate(keys)


def _signatures(width: int, scheme: Scheme, percent: int, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            sets = list(shingle_sets(*text_buffers(batch.column("text")), width))
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            digests = np.zeros((2, len(sets)), np.uint64)
            bands, tiny = [None] * len(sets), [None] * len(sets)
            if len(full):
                own = [sets[k] for k in full.tolist()]
                flat, first = np.concatenate(own), np.cumsum(size[full]) - size[full]
                digests[0, full] = np.add.reduceat(flat, first)
                digests[1, full] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), first)
                low = scheme.all_minima(own)
                for k, elements, row, bits in zip(full.tolist(), own, low, scheme.signature(low)):
                    bands[k] = _keys(elements, row, scheme, percent, short)
                    tiny[k] = bits.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(tiny, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "tiny"])
    return run


def _words(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """The signatures of a batch, one row of 64-bit words each."""
    return text_buffers(batch.column(column))[0].view(np.uint64).reshape(batch.num_rows, -1)


def differing(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of bits in which rows i of `a` and rows j of `b` differ."""
    out = np.zeros(len(i), np.int64)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[i, w] ^ b[j, w])
    return out


def _alike(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                every = np.arange(batch.num_rows)
                good = np.flatnonzero(differing(_words(batch, "ta"), every, _words(batch, "tb"), every) <= scheme.differ)
                yield batch.select(["a", "b"]).take(pa.array(good))
    return run


def _exact(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes([whole], "xa", SLICE):
                sets = zip(shingle_sets(*text_buffers(batch.column("xa")), width), shingle_sets(*text_buffers(batch.column("xb")), width))
                good = []
                for x, y in sets:
                    both = _common(x, y) if len(x) and len(y) else 0
                    good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                keep = np.flatnonzero(good)
                yield batch.select(["a", "b"]).take(pa.array(keep))
    return run


def _verified(pairs: DataFrame, core: DataFrame, docs: DataFrame, width: int, percent: int, scheme: Scheme, own: list) -> DataFrame:
    """Pairs (a, b) → those alike by signature and then at least `percent` similar on their full sets."""
    tiny = core.select("doc_id", "tiny")
    near = pairs.join(tiny.toDF("a", "ta"), "a").join(tiny.toDF("b", "tb"), "b")
    used: list[str] = []
    near = settled(near.mapInArrow(released(_alike(scheme)), "a long, b long"), "alike", used)
    named = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
    texts = settled(only_members(docs, named, "doc_id"), "texts", used)
    full = near.join(texts.toDF("a", "xa"), "a").join(texts.toDF("b", "xb"), "b")
    links = settled(full.mapInArrow(released(_exact(width, percent)), "a long, b long").distinct(), "links", own)
    drop_tables(docs.sparkSession, used)
    return links


def _candidates(batch: pa.RecordBatch, scheme: Scheme, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the pairs of a batch of whole groups that may be alike and are in different components.

    Rows are sorted by key, x, y, block and size, so the partners of a row are neighbours: sizes of like sets differ by the
    similarity at most. Of two sets that meet at places p and q of their sorted elements, for the first time there, no more
    than the elements from there on are common: a pair that fails by that either is not alike or meets in an earlier bucket.
    What passes is judged by signature.
    """
    n = batch.num_rows
    key, x, y, block, size, place, component = (batch.column(c).to_numpy().astype(np.int64) for c in ("key", "x", "y", "block", "size", "place", "component"))
    group = np.zeros(n, np.int64)
    group[1:] = np.cumsum((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    side = group * 2 + (block != x)                         # within x = y one side, else two
    other = np.where(x == y, side, np.where(block == x, side + 1, -1))
    at = side << 32 | size
    low = np.searchsorted(at, other << 32 | -(-size * percent // 100), "left")
    high = np.searchsorted(at, other << 32 | np.minimum(size * 100 // percent, (1 << 32) - 1), "right")
    low = np.where(x == y, np.maximum(low, np.arange(n) + 1), low)
    many = np.where(other < 0, 0, np.maximum(high - low, 0))
    total = np.concatenate(([0], np.cumsum(many)))
    bits = _words(batch, "tiny")
    start = 0
    while start < n:
        stop = max(int(np.searchsorted(total, total[start] + PAIRS, "right")) - 1, start + 1)
        i = np.repeat(np.arange(start, stop), many[start:stop])
        j = np.arange(len(i)) + np.repeat(low[start:stop] - (total[start:stop] - total[start]), many[start:stop])
        start = stop
        need = -(-percent * (size[i] + size[j]) // (100 + percent))
        fit = np.flatnonzero((component[i] != component[j]) & (np.minimum(size[i] - place[i], size[j] - place[j]) >= need))
        i, j = i[fit], j[fit]
        good = differing(bits, i, bits, j) <= scheme.differ
        if good.any():
            yield i[good], j[good]


def _open_members(scheme: Scheme, percent: int):
    """The members of a bucket that agree by signature with a member of another component; not the pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["key", "x", "y"]):
            hit = np.zeros(batch.num_rows, bool)
            for i, j in _candidates(batch, scheme, percent):
                hit[i] = True
                hit[j] = True
            if hit.any():
                yield batch.filter(pa.array(hit))
    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """The number of common elements of two sorted sets."""
    if len(x) < len(y):
        x, y = y, x
    return int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))


def _across(scheme: Scheme, percent: int):
    """Links between components of a bucket, confirmed on full sets; a pair already joined here is passed over, so the
    links found are at most one fewer than the members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["key", "x", "y"]):
            raw, offsets = text_buffers(batch.column("own"))
            words, cut = raw.view(np.uint64), offsets // 8
            ids, names = batch.column("doc_id").to_numpy(), batch.column("component").to_numpy()
            up: dict[int, int] = {}                         # links hold wherever they are found

            def top(c: int) -> int:
                while c in up:
                    c = up[c]
                return c

            found = []
            for i, j in _candidates(batch, scheme, percent):
                for a, b in zip(i.tolist(), j.tolist()):
                    ca, cb = top(int(names[a])), top(int(names[b]))
                    if ca == cb:
                        continue
                    u, v = words[cut[a] : cut[a + 1]], words[cut[b] : cut[b + 1]]
                    both = _common(u, v)
                    if 100 * both >= percent * (len(u) + len(v) - both):
                        found.append((ids[a], ids[b]))
                        up[max(ca, cb)] = min(ca, cb)
            if found:
                a, b = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            own = [s.tobytes() for s in shingle_sets(*text_buffers(batch.column("text")), width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.binary())], names=["doc_id", "own"])
    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, short: int = 0) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if the Jaccard similarity of their sets of `width`-word shingles is at least `percent` / 100;
    words are runs without ASCII white space, A-Z as a-z; a shorter text is one element, a text without words is empty
    and linked with nothing. component_id is the smallest doc_id reachable by links, kept marks it.

    1. Minima and band keys per document (40 × 6: a pair at 0.8 shares no band with a chance of 5e-6); equal sets are one class (128-bit digest), represented by its smallest id.
       Sets of up to `short` shingles have the exact keys of `_keys` in place of bands.
    2. In each bucket every member is compared with the bucket's smallest id only: a star, not all pairs.
    3. Pairs pass the signature check, then the exact check on full texts; components by large-star and small-star.
    4. In buckets that still hold more than one component, members that agree by signature with one of another component
       meet again, in blocks, with their full sets; links that join components are kept and the components joined. So no
       pair that shares a bucket is passed over, and no task emits all pairs.

    Null texts are empty. Rows with a null doc_id stay single: component_id null, kept true. Repeated rows return
    repeatedly; rows that share an id are each judged by their own text. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own: list[str] = []
    wide: list[str] = []                                    # tables with keys: dropped as soon as narrower ones are written
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scheme = Scheme(bands, rows, percent / 100)
    sigs = settled(docs.mapInArrow(released(_signatures(width, scheme, percent, short)), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, tiny binary"), "minima", wide)
    digest = ["n_shingles", "d1", "d2"]
    digests = settled(sigs.select("doc_id", *digest), "digests")
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = settled(digests.where("n_shingles > 0 and doc_id is not null").groupBy(*digest).agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), *[F.col(c).alias(f"r_{c}") for c in digest])
    core = full.join(reps, "doc_id").where("n_shingles = r_n_shingles and d1 = r_d1 and d2 = r_d2").select("doc_id", "bands", "tiny", F.col("n_shingles").alias("size"))
    keyed: list[str] = []
    core = settled(core, "core", keyed)
    drop_tables(spark, wide)
    members = core.select("doc_id", F.posexplode("bands").alias("place", "key"), (F.size("bands") - F.when(F.col("size") > short, bands).otherwise(0)).alias("prefix"))
    members = members.select("doc_id", "key", F.when(F.col("place") < F.col("prefix"), F.col("place")).otherwise(0).alias("place"))  # band keys have no place
    buckets = members.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("n"))
    buckets = settled(buckets.where("a <> z").drop("z"), "buckets", keyed)
    inside = settled(members.join(buckets, "key").select("key", "doc_id", "place", "a", "n"), "inside", wide)
    core = settled(core.select("doc_id", "size", "tiny"), "signatures", wide)
    drop_tables(spark, keyed)
    pairs = inside.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    links = _verified(pairs, core, docs, width, percent, scheme, own)
    comps = connected_components(links.toDF("u", "v"), own)

    named = inside.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = named.select("key", "doc_id", "place", "n", F.coalesce("component", "doc_id").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = named.join(mixed, "key").join(core.select("doc_id", "size", "tiny"), "doc_id")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "doc_id", "place", "size", "component", "tiny")
    order = ["key", "x", "y", F.col("block") != F.col("x"), "size"]
    rest = rest.repartition("key", "x", "y").sortWithinPartitions(*order)
    rest = settled(rest.mapInArrow(released(_open_members(scheme, percent)), rest.schema), "open", own)
    drop_tables(spark, wide)
    sets = only_members(docs, rest.select("doc_id").distinct(), "doc_id").mapInArrow(released(_sets(width)), "doc_id long, own binary")
    more = rest.join(sets, "doc_id").repartition("key", "x", "y").sortWithinPartitions(*order)
    more = more.mapInArrow(released(_across(scheme, percent)), "a long, b long")
    more = settled(more.distinct(), "across", own)
    found = comps.toDF("u", "v").union(more.toDF("u", "v"))
    final = connected_components(found) if not more.isEmpty() else settled(comps, "components")
    drop_tables(spark, own)

    out = digests.join(classes, digest, "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    owner = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", owner.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
