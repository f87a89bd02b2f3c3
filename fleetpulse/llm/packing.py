"""Documents into training sequences: dominance reduction on the length histogram, best fit for what is left."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import settled, released
from fleetpulse.llm.tokens import encoded, encoder

SALT = 128                  # a length that a third of all rows share is ranked in so many parts
Bins = list[tuple[int, list[tuple[int, int]]]]   # (number of alike sequences, [(length, how many), ...])


def reduce_dominated(counts: np.ndarray, capacity: int) -> Bins:
    """Fix sets of at most three pieces that dominate every other set with their largest piece; lowers `counts`.

    For the largest piece a with room r left, the pieces it is fixed with can take the place of whatever an optimal
    packing puts beside it: nothing fits; a piece of exactly r; the largest b that fits, if no two pieces fit or none
    that fit together weigh more; the largest b with the largest c beside it, if no pair that fits has its smaller
    piece larger than c.
    """
    fixed: Bins = []

    def fix(*pieces: int) -> None:
        need = np.bincount(pieces, minlength=len(counts))
        times = int(min(counts[p] // need[p] for p in set(pieces)))
        counts[list(set(pieces))] -= need[list(set(pieces))] * times
        fixed.append((times, [(p, int(need[p])) for p in sorted(set(pieces), reverse=True)]))

    changed = True
    while changed:
        changed = False
        for a in np.flatnonzero(counts)[::-1].tolist():
            while counts[a]:
                counts[a] -= 1
                room = capacity - a
                there = np.flatnonzero(counts[: room + 1])
                choice = _dominating(there, counts, room)
                counts[a] += 1
                if choice is None:
                    break
                if not choice and counts[a] > 1 and 2 * a <= capacity:
                    choice = None
                    break
                fix(a, *choice)
                changed = True
    return fixed


def _dominating(there: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, ...] | None:
    """What to put beside a piece that leaves `room`; None if no rule proves a choice. `there`: lengths that fit."""
    if len(there) == 0:
        return ()
    best = int(there[-1])
    if best == room:
        return (best,)
    least = np.repeat(there[:3], np.minimum(counts[there[:3]], 3))[:3]
    if len(least) < 2 or least[:2].sum() > room:
        return (best,)
    if len(least) > 2 and least.sum() <= room:
        return None
    top = int(there[np.searchsorted(there, room - there, "right") - 1].max(initial=0))
    partner = there[np.searchsorted(there, room - there, "right") - 1]
    fits = (np.searchsorted(there, room - there, "right") > 0) & ((partner != there) | (counts[there] > 1))
    if not fits.any():
        return (best,)
    sums = (there + partner)[fits]
    if top and best >= sums.max():
        return (best,)
    beside = there[there <= room - best]
    if len(beside) and beside[-1] == best and counts[best] < 2:
        beside = beside[:-1]
    if not len(beside):
        return None
    smaller = np.minimum(there, partner)[fits].max()
    return (best, int(beside[-1])) if smaller <= beside[-1] else None


def best_fit(counts: np.ndarray, capacity: int) -> Bins:
    """Best fit, longest first, on counts of lengths: alike sequences move together."""
    open_: dict[int, list[list]] = {}   # room left → [[number, pieces], ...]
    rooms = np.zeros(capacity + 1, np.int64)

    def put(room: int, number: int, pieces: list) -> None:
        if number:
            open_.setdefault(room, []).append([number, pieces])
            rooms[room] += number

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fitting = np.flatnonzero(rooms[length:])
            room = length + int(fitting[0]) if len(fitting) else capacity
            if len(fitting):
                number, pieces = open_[room].pop()
                rooms[room] -= number
            else:
                number, pieces = left, []
            each = room // length
            full = min(number, left // each)
            rest = left - full * each if full < number else 0
            rest = min(rest, each - 1) if full < number else 0
            put(room - each * length, full, [*pieces, (length, each)])
            if rest:
                put(room - rest * length, 1, [*pieces, (length, rest)])
            if pieces:
                put(room, number - full - bool(rest), pieces)
            left -= full * each + rest
    counts[:] = 0
    return [(number, pieces) for groups in open_.values() for number, pieces in groups]


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Places for all pieces of a length: rows (length, first rank, copies per sequence, first sequence, offset), sorted.

    The piece of rank k in its length goes to the row with the largest first rank up to k. The plan depends on the
    histogram alone: at most `capacity` lengths, and each step opens at most two groups of alike sequences, so its size
    does not grow with the number of documents.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    bins = [(int(counts[capacity]), [(capacity, 1)])] if counts[capacity] else []
    counts[capacity] = 0
    bins += reduce_dominated(counts, capacity)
    bins += best_fit(counts, capacity)
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for number, pieces in bins:
        offset = 0
        for length, each in pieces:
            rows.append((length, used[length], each, sequence, offset))
            used[length] += number * each
            offset += length * each
        sequence += number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int, end: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: whole documents, only longer ones cut every `capacity` tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = encoder(tokenizer).type.itemsize
        cols: list[list] = [[], [], [], [], []]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:1]] + [pa.array(cols[1], pa.int32())]
                                              + [pa.array(c, pa.int64()) for c in cols[2:]],
                                              names=["doc_id", "piece", "start", "length", "ids_crc32"])
        for doc_id, code in encoded(batches, tokenizer, end):
            ids = np.frombuffer(code, encoder(tokenizer).type).astype("<u4")
            for piece, start in enumerate(range(0, len(code) // size, capacity)):
                part = ids[start : start + capacity]
                for col, value in zip(cols, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()))):
                    col.append(value)
            if len(cols[0]) >= 5000:
                yield out()
                cols = [[], [], [], [], []]
        if cols[0]:
            yield out()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """One row per piece of each row of `docs` (doc_id, text), with its sequence_id and gapless offset there.

    Only the histogram of lengths (at most `capacity` numbers) reaches the driver; the plan made from it is sent to the
    tasks. Pieces are numbered within their length in SALT parts, so no length has to fit one task. Null and empty
    texts are their end id alone; repeated rows and null ids are packed like any other; other columns are ignored; an
    empty table gives an empty result.
    """
    pieces = settled(cut_documents(docs, tokenizer, capacity, end), "pieces")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALT)))
    per_part = settled(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    places = plan({r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    sent = docs.sparkSession.sparkContext.broadcast(places)

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("k", F.row_number().over(inside) - 1).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("k") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        keys = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = rows[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            at, each = rank - row[:, 1], row[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 3] + at // each), pa.array(row[:, 4] + at % each * length)],
                                             names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(released(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
