"""Token ids in wavelet-matrix shards: bit planes with rank directories that answer access, count and occurrence queries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.tokens import encoded, encoder
from fleetpulse.session import scratch_path

MAGIC = b"WVM1"
BLOCK = 1 << 15             # bits of a plane that are compressed together and share one rank entry
SHARD_TOKENS = 1 << 20
TEXT_BYTES = 4 << 20        # text aimed at for one shard
MOST_PARTS = 20_000

SHARDS = "shard long, first_id long, last_id long, n_docs long, n_tokens long, data binary"


def build_shard(tokens: np.ndarray, doc_ids: list, lengths: np.ndarray, levels: int) -> bytes:
    """One compressed file: header, documents, then for each bit from the highest the zeros, rank entries and blocks.

    Plane k holds bit k of the tokens in the order left by the planes before; zeros move to the front, ones behind.
    """
    press = zstandard.ZstdCompressor(level=1).compress
    missing = np.array([d is None for d in doc_ids], np.uint8)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = press(missing.tobytes() + ids.tobytes() + lengths.astype("<i8").tobytes())
    out = [MAGIC, struct.pack("<qqqq", len(tokens), levels, len(ids), len(head)), head]
    now = tokens
    for level in range(levels - 1, -1, -1):
        bit = (now & (1 << level)) != 0
        packed = np.packbits(bit)
        step = BLOCK // 8
        parts = [press(packed[a : a + step].tobytes()) for a in range(0, len(packed), step)]
        ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), step), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
        rank = np.concatenate(([0], np.cumsum(ones))).astype("<i8")
        ends = np.cumsum([0, *map(len, parts)]).astype("<i8")
        out += [struct.pack("<q", int(len(bit) - rank[-1])), rank.tobytes(), ends.tobytes(), *parts]
        if level:
            now = np.concatenate((now[~bit], now[bit]))
    return b"".join(out)


class WaveletShard:
    """Reads one shard; `access`, `count` and `occurrences` decompress only the blocks they touch."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.n, self.levels, n_docs, size = struct.unpack_from("<qqqq", data, 4)
        self.data, self.press = data, zstandard.ZstdDecompressor()
        head = self.press.decompress(data[36 : 36 + size])
        missing = np.frombuffer(head, np.uint8, n_docs)
        ids = np.frombuffer(head, "<i8", n_docs, n_docs)
        self.doc_ids = [None if m else int(d) for m, d in zip(missing, ids)]
        self.lengths = np.frombuffer(head, "<i8", n_docs, 9 * n_docs)
        self.planes = []
        at, blocks = 36 + size, -(-self.n // BLOCK)
        for _ in range(self.levels):
            zeros = struct.unpack_from("<q", data, at)[0]
            rank = np.frombuffer(data, "<i8", blocks + 1, at + 8)
            ends = np.frombuffer(data, "<i8", blocks + 1, at + 8 + 8 * (blocks + 1))
            at += 8 + 16 * (blocks + 1)
            self.planes.append((zeros, rank, ends, at))
            at += int(ends[-1])
        self.blocks: dict[tuple[int, int], np.ndarray] = {}

    def _bits(self, level: int, block: int) -> np.ndarray:
        """The bits of one block; the last 64 blocks read are kept."""
        got = self.blocks.get((level, block))
        if got is None:
            _, _, ends, at = self.planes[level]
            got = np.unpackbits(np.frombuffer(self.press.decompress(self.data[at + int(ends[block]) : at + int(ends[block + 1])]), np.uint8))
            if len(self.blocks) >= 64:
                self.blocks.pop(next(iter(self.blocks)))
            self.blocks[level, block] = got
        return got

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, BLOCK)
        return int(self.planes[level][1][block]) + (int(self._bits(level, block)[:rest].sum()) if rest else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) zero or one of a plane."""
        rank = self.planes[level][1]
        seen = rank if bit else np.minimum(np.arange(len(rank)) * BLOCK, self.n) - rank
        block = int(np.searchsorted(seen, k, "right")) - 1
        inside = np.flatnonzero(self._bits(level, block)[: self.n - block * BLOCK] == bit)
        return block * BLOCK + int(inside[k - int(seen[block])])

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level, (zeros, *_) in enumerate(self.planes):
            bit = int(self._bits(level, i // BLOCK)[i % BLOCK])
            token = token << 1 | bit
            i = zeros + self._rank1(level, i) if bit else i - self._rank1(level, i)
        return token

    def _span(self, token: int, end: int) -> tuple[int, int]:
        a, b = 0, end
        for level, (zeros, *_) in enumerate(self.planes):
            ra, rb = self._rank1(level, a), self._rank1(level, b)
            a, b = (zeros + ra, zeros + rb) if token >> (self.levels - 1 - level) & 1 else (a - ra, b - rb)
        return a, b

    def count(self, token: int, end: int | None = None) -> int:
        """How often `token` stands among the first `end` tokens (all if None; `end` is clamped to 0 … n)."""
        if token < 0 or token >> self.levels:
            return 0
        a, b = self._span(token, self.n if end is None else min(max(end, 0), self.n))
        return b - a

    def occurrences(self, token: int) -> list[int]:
        """All positions of `token`, ascending."""
        if token < 0 or token >> self.levels:
            return []
        a, b = self._span(token, self.n)
        out = []
        for i in range(a, b):
            for level in range(self.levels - 1, -1, -1):
                bit = token >> (self.levels - 1 - level) & 1
                i = self._select(level, bit, i - self.planes[level][0] if bit else i)
            out.append(i)
        return out

    def decode(self) -> np.ndarray:
        """All tokens in order, plane by plane from the lowest bit."""
        now = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            zeros, _, ends, at = self.planes[level]
            raw = b"".join(self.press.decompress(self.data[at + int(a) : at + int(b)]) for a, b in zip(ends[:-1], ends[1:]))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).astype(bool)
            before = np.empty_like(now)
            before[~bit] = now[:zeros]
            before[bit] = now[zeros:] | now.dtype.type(1 << (self.levels - 1 - level))
            now = before
        return now.astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end: int = 2) -> None:
    """Encode every whole text of `docs` (doc_id, text) and write the shards to `folder`, ascending by doc_id.

    The ranges of ids that go to one task are quantiles of doc_id over all rows, read from that column alone; a task
    sorts its ranges and closes a shard after SHARD_TOKENS tokens, so memory is bounded whatever a range holds.
    A row of the Parquet folder is one shard file; any store that Spark writes can hold it.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    amount = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(max(amount // TEXT_BYTES, 1), MOST_PARTS))
    cuts = slim.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, codes: list) -> pa.RecordBatch:
            part = [-1 if d is None else int(p) for d, p in zip(ids, np.searchsorted(cuts, [d or 0 for d in ids]))]
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(ids, pa.int64()), pa.array(codes, pa.binary())],
                                              names=["part", "doc_id", "codes"])
        ids, codes = [], []
        for doc_id, code in encoded(batches, tokenizer, end):
            ids.append(doc_id)
            codes.append(code)
            if len(ids) >= 500:
                yield out(ids, codes)
                ids, codes = [], []
        if ids:
            yield out(ids, codes)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(tokenizer).type
        levels = max(int(max(encoder(tokenizer).whole.get_vocab_size(), end + 1) - 1).bit_length(), 1)
        part, made, size, ids, codes = None, 0, 0, [], []

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(c) // kind.itemsize for c in codes])
            data = build_shard(np.frombuffer(b"".join(codes), kind), ids, lengths, levels)
            known = [d for d in ids if d is not None]
            row = [(part + 1 << 32) + made, min(known, default=None), max(known, default=None), len(ids), int(lengths.sum())]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row] + [pa.array([data], pa.binary())],
                                              names=[x.split()[0] for x in SHARDS.split(", ")])
        for batch in batches:
            for p, doc_id, code in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("codes")):
                if ids and (p != part or size >= SHARD_TOKENS * kind.itemsize):
                    yield shard()
                    made, size, ids, codes = made + 1 if p == part else 0, 0, [], []
                part = p
                ids.append(doc_id)
                codes.append(code.as_py())
                size += len(codes[-1])
        if ids:
            yield shard()

    rows = slim.mapInArrow(encode, "part long, doc_id long, codes binary")
    rows = rows.repartition("part").sortWithinPartitions("part", "doc_id", "codes")
    rows.mapInArrow(build, SHARDS).write.parquet(folder)


def read_shards(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all read from the shard files."""
    shards = spark.read.schema(SHARDS).parquet(folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
                one = WaveletShard(data.as_py())
                raw = memoryview(one.decode().astype("<u4").tobytes())
                ends = np.cumsum(one.lengths)
                starts = ends - one.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(crc), pa.int64()), pa.array(one.doc_ids, pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(one.lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    docs = shards.select("shard", "data").mapInArrow(decode, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return docs.join(bases, "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark, folder: str, tokens: list[int]) -> DataFrame:
    """shard, token, n, positions: how often and where each given token stands, straight from the bit planes."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
                one = WaveletShard(data.as_py())
                for token in tokens:
                    at = one.occurrences(token)
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([token], pa.int64()), pa.array([one.count(token)], pa.int64()),
                                                      pa.array([at], pa.list_(pa.int64()))], names=["shard", "token", "n", "positions"])
    return spark.read.schema(SHARDS).parquet(folder).select("shard", "data").mapInArrow(find, "shard long, token long, n long, positions array<long>")


def token_files(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write wavelet shards of all documents and return what the files say: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before, in ascending doc_id order (null ids first, equal ids by their
    codes). Null and empty texts are just the end id. Other columns are ignored; an empty table gives an empty result.
    """
    folder = scratch_path(docs.sparkSession, "wavelet")
    write_shards(docs, tokenizer, folder, end)
    return read_shards(docs.sparkSession, folder)
