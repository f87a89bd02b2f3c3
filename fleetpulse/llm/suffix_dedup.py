"""Exact repeated byte strings across all documents: content anchors name what is equal, external induced sorting decides the rest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import _BACK, _STEP, KEEP_POWERS, by_bytes, drop_tables, member_sides, mix, only_members, settled, text_buffers, released
from fleetpulse.llm.suffix_sort import SuffixSorter

GRAM = 16                   # bytes that choose an anchor
SHARD_SYMBOLS = 1 << 18     # strings that are sorted together, unless one group alone is larger
SLICE = 1 << 18             # bytes of text whose anchors are found at once
CODE = 3                    # symbols that stand for a group's common core in a shard's text
HOT_CONTEXTS = 200_000      # distinct contexts of one core that are sorted in one task; of more, single windows are counted

_BASES = (_STEP, 0xD1342543DE82EF95)
_VALUES = np.random.default_rng(5).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


class _Sums:
    """Running weighted sums of a byte string; `hashes(a, b, k)` are 64-bit hashes of raw[a:b] in family k."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, raw: np.ndarray):
        self.down, self.total = [], []
        for k, base in enumerate(_BASES):
            up, down = self._powers(k, base, len(raw) + 1)
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_VALUES[k][raw] * up[:-1], out=total[1:])
            self.down.append(down)
            self.total.append(total)

    @classmethod
    def _powers(cls, k: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Kept for the worker's life up to KEEP_POWERS entries; a longer text gets its own tables, dropped after use."""
        if k in cls.tables and len(cls.tables[k][0]) >= n:
            return cls.tables[k][0][:n], cls.tables[k][1][:n]
        made = []
        for factor in (base, _BACK if k == 0 else pow(base, -1, 1 << 64)):
            full = np.full(n, factor, np.uint64)
            full[0] = 1
            made.append(np.multiply.accumulate(full))
        if n <= KEEP_POWERS:
            cls.tables[k] = (made[0], made[1])
        return made[0], made[1]

    def hashes(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        return mix((self.total[k][b] - self.total[k][a]) * self.down[k][a])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for all i, from minima to and from block borders."""
    n = len(x)
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _geometry(length: int) -> tuple[int, int]:
    """The reach of anchors and the length of the core: for length 400, 128 window starts and 273 bytes."""
    reach = max(min(128, (length - GRAM) // 2), 1)
    return reach, length - reach + 1


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Every window of `length` bytes inside a text has one anchor: the first position among its first `reach` starts
    whose GRAM bytes have the smallest hash. Windows with the same anchor are neighbours.

    Returns anchor, first and last window start, and two hashes: of the core (the bytes that all windows with this anchor
    can have in common) and of the whole stretch from the first window's start to the last window's end. Equal windows
    have anchors at equal distances, so also equal cores.
    """
    reach, core = _geometry(length)
    n = len(raw)
    if n < length or length < GRAM + 1:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = _Sums(raw)
    at = np.arange(n - GRAM + 1)
    key = (sums.hashes(at, at + GRAM, 0) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    best = (_sliding_least(key, reach) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(n - length + 1)
    doc_end = offsets[np.searchsorted(offsets, starts, "right")] if len(offsets) > 2 else np.full(len(starts), n)
    starts = starts[starts + length <= doc_end]
    anchor = best[starts]
    if not len(starts):
        return anchor, starts, starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    anchor = anchor[new]
    hash_core = sums.hashes(anchor, anchor + core, 0)
    whole = sums.hashes(first, last + length, 1)
    whole = mix(whole ^ (mix((anchor - first).astype(np.uint64)) + (last - first).astype(np.uint64)))
    return anchor, first, last, hash_core, whole


def _anchored(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            raw, offsets = text_buffers(batch.column("text"))
            anchor, first, last, core, whole = anchors(raw, offsets, length)
            doc = np.searchsorted(offsets, first, "right") - 1
            base = offsets[doc]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("k").take(take), pa.array((anchor - base).astype(np.int32)), pa.array((first - base).astype(np.int32)),
                 pa.array((last - base).astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))],
                names=["doc_id", "k", "anchor", "first", "last", "core", "whole"])
    return run


def _strings(length: int):
    """Texts with the contexts wanted from them → each context's bytes before and behind its core."""
    reach, core = _geometry(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["doc_id", "k", "anchor", "first", "last", "core", "whole", "n"]
            left, right = [], []
            for text, rows in zip(batch.column("text"), batch.column("wanted").to_pylist()):
                raw = (text.as_py() or "").encode()
                for r in rows:
                    left.append(raw[r["first"] : r["anchor"]])
                    right.append(raw[r["anchor"] + core : r["last"] + length])
            wanted = batch.column("wanted").combine_chunks() if isinstance(batch.column("wanted"), pa.ChunkedArray) else batch.column("wanted")
            flat = wanted.flatten()
            owner = pa.array(np.repeat(np.arange(batch.num_rows), [len(r) for r in wanted.to_pylist()]), pa.int64())
            cols = [batch.column("doc_id").take(owner), batch.column("k").take(owner)] + [flat.field(c) for c in names[2:]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=[*names, "left", "right"])
    return run


def repeated_starts(groups: list[int], lefts: list[bytes], rights: list[bytes], reach: int, limit: int = 1 << 23) -> list[np.ndarray]:
    """Of each string left + core + right the window starts that another string of its group repeats.

    The core stands as CODE symbols of its own, so a window is a fixed number of symbols and only windows of one group at
    one distance from the core can be equal. One text of all strings is sorted with common prefixes; a suffix whose
    common prefix with a neighbour reaches a window's length is repeated.
    """
    size = reach - 1 + CODE
    codes = np.array(groups, np.int64)
    digits = np.stack([codes >> 16 & 255, codes >> 8 & 255, codes & 255], 1) + 258
    parts, starts, at = [], [], 0
    for k, (left, right) in enumerate(zip(lefts, rights)):
        starts.append(at)
        parts += [np.frombuffer(left, np.uint8).astype(np.int32) + 2, digits[k].astype(np.int32), np.frombuffer(right, np.uint8).astype(np.int32) + 2,
                  np.ones(1, np.int32)]
        at += len(left) + CODE + len(right) + 1
    text = np.concatenate([*parts, np.zeros(1, np.int32)])
    sorter = SuffixSorter(text, size, limit)
    again = np.zeros(len(text), bool)
    before = None
    for where, common in sorter.suffixes():
        long_ = common >= size
        again[where[long_]] = True
        behind = np.flatnonzero(long_)
        again[where[behind[behind > 0] - 1]] = True
        if len(long_) and long_[0] and before is not None:
            again[before] = True
        before = where[-1]
    sorter.close()
    out = []
    for k, start in enumerate(starts):
        last = len(lefts[k]) + CODE + len(rights[k]) - size
        out.append(np.flatnonzero(again[start : start + last + 1]))
    return out


def _sorted_groups(length: int):
    """A partition sorted by core → window spans of the contexts that occur once as a whole. Whole groups are gathered up
    to SHARD_SYMBOLS and sorted together."""
    reach, _ = _geometry(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        amount = 0

        def solve() -> pa.RecordBatch:
            names = {c: k for k, c in enumerate(dict.fromkeys(r["core"] for r in rows))}
            found = repeated_starts([names[r["core"]] for r in rows], [r["left"] for r in rows], [r["right"] for r in rows], reach)
            out: dict[str, list] = {c: [] for c in ("doc_id", "k", "start", "stop")}
            for r, starts in zip(rows, found):
                if r["n"] == 1 and len(starts):
                    cut = np.flatnonzero(np.concatenate(([True], np.diff(starts) > 1)))
                    for a, b in zip(starts[cut].tolist(), starts[np.append(cut[1:], len(starts)) - 1].tolist()):
                        for c, v in zip(out, (r["doc_id"], r["k"], r["first"] + a, r["first"] + b + length)):
                            out[c].append(v)
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

        for batch in batches:
            for row in batch.to_pylist():
                if amount >= SHARD_SYMBOLS and row["core"] != rows[-1]["core"]:
                    yield solve()
                    rows, amount = [], 0
                rows.append(row)
                amount += len(row["left"]) + len(row["right"]) + CODE + 1
        if rows:
            yield solve()
    return run


def _single_windows(length: int):
    """Contexts of very common cores → one row per window, with two hashes of its bytes beside the core."""
    reach, _ = _geometry(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sides = [_Sums(text_buffers(part.column(c))[0]) for c in ("left", "right")]
                lo, ro = (text_buffers(part.column(c))[1] for c in ("left", "right"))
                windows = np.diff(lo) + np.diff(ro) + 1 - (reach - 1)
                row = np.repeat(np.arange(part.num_rows), windows)
                w = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                before = lo[row + 1] - lo[row] - w                    # bytes in front of the core
                pair = [mix(sides[0].hashes(lo[row] + w, lo[row + 1], k) + np.uint64(3) * sides[1].hashes(ro[row], ro[row] + reach - 1 - before, k)
                            + mix(before.astype(np.uint64))) for k in (0, 1)]
                take = pa.array(row)
                start = part.column("first").to_numpy()[row].astype(np.int64) + w
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("k").take(take), pa.array(start), part.column("core").take(take),
                     part.column("n").take(take), pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64))],
                    names=["doc_id", "k", "start", "core", "n", "h1", "h2"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their spans → merged spans and the bytes that are left."""
    for batch in batches:
        merged_out, left_out, removed, n = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            raw = (text.as_py() or "").encode()
            pairs = np.array([(s["start"], s["stop"]) for s in spans], np.int64).reshape(-1, 2)
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            reach = np.maximum.accumulate(pairs[:, 1]) if len(pairs) else pairs[:, 1]
            new = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] > reach[:-1]))) if len(pairs) else np.zeros(0, int)
            runs = [(int(pairs[a, 0]), int(reach[b - 1])) for a, b in zip(new, [*new[1:], len(pairs)])]
            left, at = [], 0
            for a, b in runs:
                left.append(raw[at:a])
                at = b
            left_out.append(b"".join([*left, raw[at:]]))
            merged_out.append([{"start": a, "stop": b} for a, b in runs])
            removed.append(sum(b - a for a, b in runs))
            n.append(len(raw))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("k"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged_out, kind),
             pa.array([hashlib.sha256(x).hexdigest() for x in left_out]), pa.array(left_out, pa.binary())],
            names=["doc_id", "k", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


CUT = "doc_id long, k long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string, kept binary"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k, text: rows are told apart by id and a hash of the text, so equal rows share their result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.col("doc_id").cast("long")).alias("k"), text.alias("text"))


def repeated_bytes(docs: DataFrame, length: int = 400) -> DataFrame:
    """Texts of `docs` (doc_id, text) that hold a string of `length` bytes which also starts anywhere else, in the same text
    or another: doc_id, k, n_bytes, n_removed, spans (maximal covered byte runs), kept_sha256, kept (the other bytes).

    1. Each window of `length` bytes has an anchor chosen by content, and windows with equal contents have equal cores
       around it. Cores that occur once hold no repeated window; they are counted before they are exchanged.
    2. Contexts (core and all around it that its windows reach) that are equal as a whole, by two independent 64-bit
       hashes, repeat all their windows: the insides of copied passages, however often they are copied.
    3. What is left are cores with different contexts, where copies begin, end or differ. One string of each distinct
       context goes, dealt by core, to shards whose suffixes are put in order with their common prefixes by external
       induced sorting (`suffix_sort`); a window repeats if its common prefix with a neighbour is a window long. A core
       with more than HOT_CONTEXTS contexts is not given to one task: its windows are hashed and counted one by one.

    Texts are UTF-8 bytes; null texts are empty; matches never cross texts. Texts without repeated strings, and equal rows
    (same id and text) beyond one, are not in the result. Null ids stay null. Other columns are ignored; an empty table
    gives an empty result.
    """
    own: list[str] = []
    keyed = _keyed(docs)
    found = settled(keyed.mapInArrow(released(_anchored(length)), "doc_id long, k long, anchor int, first int, last int, core long, whole long"), "anchors", own)
    cores = found.groupBy("core").agg(F.count("*").alias("n"), F.min("whole").alias("w0"), F.max("whole").alias("w1")).where("n > 1")
    cores = settled(cores.select("core", (F.col("w0") != F.col("w1")).alias("differ")), "cores", own)
    shared = settled(only_members(found, cores.select("core"), "core"), "shared", own)
    contexts = shared.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "k", "anchor", "first", "last")).alias("one"))
    contexts = settled(contexts, "contexts", own)
    same = shared.join(contexts.where("n > 1").select("core", "whole"), ["core", "whole"])
    same = same.select("doc_id", "k", F.col("first").cast("long").alias("start"), (F.col("last") + length).cast("long").alias("stop"))

    wanted = contexts.join(cores.where("differ").select("core"), "core").select("one.*", "core", "whole", "n")
    wanted = wanted.groupBy("doc_id", "k").agg(F.collect_list(F.struct("anchor", "first", "last", "core", "whole", "n")).alias("wanted"))
    wanted = settled(wanted, "wanted", own)
    texts = only_members(keyed, wanted.select("k").distinct(), "k").withColumnRenamed("doc_id", "d").withColumnRenamed("k", "j").dropDuplicates(["d", "j"])
    strings = wanted.join(texts, (F.col("k") == F.col("j")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "k", "text", "wanted")
    strings = strings.mapInArrow(released(_strings(length)), "doc_id long, k long, anchor int, first int, last int, core long, whole long, n long, left binary, right binary")
    many = contexts.groupBy("core").agg(F.count("*").alias("size")).where(F.col("size") > HOT_CONTEXTS).select("core")
    many = settled(many, "many", own)
    if not many.isEmpty():
        strings = settled(strings, "strings", own)
    rest = strings.join(many, "core", "left_anti").repartition("core").sortWithinPartitions("core")
    parts = rest.mapInArrow(released(_sorted_groups(length)), "doc_id long, k long, start long, stop long")
    if not many.isEmpty():
        windows = strings.join(many, "core", "left_semi").select(*strings.columns)
        windows = windows.mapInArrow(released(_single_windows(length)), "doc_id long, k long, start long, core long, n long, h1 long, h2 long")
        windows = settled(windows, "windows", own)
        twice = windows.groupBy("core", "h1", "h2").agg(F.count("*").alias("times")).where("times > 1").drop("times")
        hot = windows.where("n = 1").join(twice, ["core", "h1", "h2"]).select("doc_id", "k", "start", (F.col("start") + length).alias("stop"))
        parts = parts.union(hot)

    spans = same.union(parts).groupBy("doc_id", "k").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = settled(spans, "spans", own)
    texts = only_members(keyed, spans.select("k"), "k").withColumnRenamed("doc_id", "d").withColumnRenamed("k", "j").dropDuplicates(["d", "j"])
    texts = spans.join(texts, (F.col("k") == F.col("j")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "k", "text", "spans")
    out = settled(texts.mapInArrow(released(_cut), CUT), "cut")
    drop_tables(docs.sparkSession, own)
    return out


def _back(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` (doc_id, k, ...) with the columns of `found` where the row has any."""
    found = found.withColumnRenamed("doc_id", "__d").withColumnRenamed("k", "__k")
    return docs.join(found, (F.col("k") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left").drop("__d", "__k")


def byte_report(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of `docs`."""
    found = repeated_bytes(docs, length).select("doc_id", "k", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
    rows = _keyed(docs).select("doc_id", "k", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return _back(rows, found).select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
                                     F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """All rows and columns of `docs` with the repeated bytes taken out of `text`; a character cut in two leaves U+FFFD."""
    found = repeated_bytes(docs, length).select(F.col("doc_id").alias("__d"), F.col("k").alias("__k"), F.make_valid_utf8(F.col("kept").cast("string")).alias("__left"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("__key", F.xxhash64(text, F.col("doc_id").cast("long")))
    side = member_sides(keyed, found.select("__k"), "__key")
    hit = side(True).join(found, (F.col("__key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left")
    hit = hit.select(*[F.coalesce("__left", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return side(False).select(*docs.columns).union(hit)
