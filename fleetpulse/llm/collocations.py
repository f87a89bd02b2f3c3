"""Phrase collocations by counting quotient filters: packed word-id n-grams, invertibly permuted into a quotient and a
full remainder, counted per shard in quotient order and merged across shards.

1. Words: A-Z lower-cased, texts cut into pieces at `[.,;:!?\\x0A-\\x0D]`, pieces into words `[^\\x20\\x09]+` (byte tables
   over slices of texts). Word counts per (lang, word), partial ones per slice, give n per lang and the vocabulary.
2. Only words that occur at least `min_count` times in some lang can stand in a candidate (a phrase's every word occurs
   at least as often as the phrase), so only they get ids 1 … V; any other word breaks the n-grams around it. The
   vocabulary is sent to the tasks when its counted size is under BROADCAST_BYTES, else word ids are joined to the
   word stream by a shuffle (hot words are split by the skew join).
3. Per piece, every 1-, 2- and 3-gram of ids is packed into two halves of h = 2B bits (B bits an id): (order, first id)
   and (second id, third id). A four-round Feistel network on the halves is a permutation of the 2h-bit keys; the top
   QUOTIENT_BITS of it are the quotient (the filter's slot) and the rest the remainder, stored whole, so no key is ever
   confused with another (lossless). Each task sorts its keys by (quotient, remainder) and counts equal runs: the
   counters of its filter in slot order. Spark merges the sorted filters of all shards by their (quotient, remainder).
4. Merged counters of at least `min_count` are inverted back to n-grams; cuts, scores, the drop rule and the ranking
   are joins and windows. Scores are exact: floor(10^6 a² / (l r)) in 38-digit decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import by_bytes, drop_tables, mix, released, settled, text_buffers, word_spans

# fixed values of the contract
PIECE_BREAKS = "[.,;:!?\\n\\x0B\\x0C\\r]"
WORD_BREAKS = "[ \\t]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)          # the same as byte tables: piece breaks, and all between words
_BREAK[list(b".,;:!?\n\x0B\x0C\r")] = True
_GAP[list(b" \t")] = True
_GAP |= _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

QUOTIENT_BITS = 16
BROADCAST_BYTES = 64 << 20
ROUNDS = [np.uint64(c) for c in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, words): one row per document, its words as an array of pieces (null lang: `und`, null text: empty)."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    split = F.transform(F.split(text, PIECE_BREAKS), lambda p: F.filter(F.split(p, WORD_BREAKS), lambda w: w != ""))
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), split.alias("words"))


class Feistel:
    """A permutation of keys given as two halves of `h` bits each (h ≤ 64); `backward` undoes `forward`."""

    def __init__(self, h: int):
        self.h = h
        self.mask = np.uint64((1 << h) - 1) if h < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)

    def _f(self, x: np.ndarray, k: int) -> np.ndarray:
        return mix(x ^ ROUNDS[k]) & self.mask

    def forward(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in range(len(ROUNDS)):
            left, right = right, left ^ self._f(right, k)
        return left, right

    def backward(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in reversed(range(len(ROUNDS))):
            left, right = right ^ self._f(left, k), left
        return left, right


def _layout(bits: int) -> tuple[int, int]:
    """Half width h and the quotient's bits for ids of `bits` bits."""
    h = max(2 * bits, bits + 2)
    if h > 64:
        raise ValueError("more than 2^32 frequent words")
    return h, min(QUOTIENT_BITS, h)


def _ngram_keys(ids: np.ndarray, bits: int, orders=(1, 2, 3), pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Packed halves of all n-grams of the given orders over nonzero ids (0 breaks). With `pairs` (sorted keys
    id1 << bits | id2 of the frequent 2-grams) a 3-gram is kept only if both of its 2-grams are among them."""
    ids = ids.astype(np.uint64)
    b = np.uint64(bits)
    lefts, rights = [], []
    n = len(ids)
    for order in orders:
        if n < order:
            continue
        m = n - order + 1
        ok = np.ones(m, bool)
        for k in range(order):
            ok &= ids[k : k + m] != 0
        if order == 3 and pairs is not None:
            for k in (0, 1):
                key = (ids[k : k + m] << b) | ids[k + 1 : k + 1 + m]
                at = np.searchsorted(pairs, key)
                ok &= (at < len(pairs)) & (pairs[np.minimum(at, len(pairs) - 1)] == key) if len(pairs) else False
        at = np.flatnonzero(ok)
        first = ids[at]
        second = ids[at + 1] if order > 1 else np.zeros(len(at), np.uint64)
        third = ids[at + 2] if order > 2 else np.zeros(len(at), np.uint64)
        lefts.append((np.uint64(order) << b) | first)
        rights.append((second << b) | third)
    if not lefts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(lefts), np.concatenate(rights)


CHUNK_WORDS = 1 << 18      # words of one numpy pass: some 100 bytes of n-gram keys and sorting each
TEXT_BYTES = 1 << 22       # bytes of text split into words at once; fewer, longer slices give fewer partial counts


def _by_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK_WORDS ids (a longer row stands alone), so that memory follows the slice, not the batch."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("ids")).fill_null(0).to_numpy().astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + CHUNK_WORDS, "right"))
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lower-cased words of a column of texts, the first word of each text, and which words begin a piece."""
    raw, offsets = text_buffers(texts)
    raw = _LOWER[raw]
    starts, ends, first = word_spans(raw, offsets, _GAP)
    begins = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(begins), pa.py_buffer(raw[~_GAP[raw]]))
    breaks = np.concatenate(([0], np.cumsum(_BREAK[raw], dtype=np.int32)))
    opens = np.ones(len(starts), bool)
    opens[1:] = breaks[starts[1:]] != breaks[ends[:-1]]
    opens[first[:-1][first[:-1] < len(starts)]] = True
    return words, first, opens


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (lang, text) → (lang, word, f), counted within a slice of texts."""
    for batch in by_bytes(batches, "text", TEXT_BYTES):
        words, first, _ = _split(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        code = np.repeat(langs.indices.to_numpy(), np.diff(first))
        got = pa.table({"lang": code, "word": words}).group_by(["lang", "word"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
        for part in got.to_batches():
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(part.column("lang")), part.column("word"), part.column("count_all")], names=["lang", "word", "f"])


def _to_ids(vocab: pa.Array):
    """mapInArrow: (lang, text) → (lang, ids: list<int>), frequent words 1 … V, others 0, a 0 before each piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", TEXT_BYTES):
            words, first, opens = _split(batch.column("text"))
            ids = pc.index_in(words, value_set=vocab).fill_null(-1).to_numpy() + np.int32(1)
            stream = np.insert(ids, np.flatnonzero(opens), 0)
            ends = (first + np.concatenate(([0], np.cumsum(opens)))[first]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.ListArray.from_arrays(pa.array(ends), pa.array(stream, pa.int32()))], names=["lang", "ids"])
    return run


def _filters(bits: int, orders=(1, 2, 3), pairs: np.ndarray | None = None):
    """mapInArrow over (lang, ids): each slice's counting quotient filter, per lang, as sorted (quotient, remainder, count) rows."""
    h, q = _layout(bits)
    perm = Feistel(h)
    low = np.uint64((1 << (h - q)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_words(batches):
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                part = batch.filter(pc.equal(langs, lang))
                stream = pc.list_flatten(part.column("ids")).to_numpy()
                left, right = _ngram_keys(stream, bits, orders, pairs)
                if not len(left):
                    continue
                left, right = perm.forward(left, right)
                quotient = left >> np.uint64(h - q)
                order = np.lexsort((right, left))
                left, right = left[order], right[order]
                new = np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
                starts = np.flatnonzero(new)
                counts = np.diff(np.append(starts, len(left)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(starts), pa.string()), pa.array(quotient[order][starts].astype(np.int64)),
                     pa.array((left[starts] & low).view(np.int64)), pa.array(right[starts].view(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["lang", "quotient", "rem_hi", "rem_lo", "f"])
    return run


def _inverse(bits: int):
    h, q = _layout(bits)
    perm = Feistel(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << bits) - 1)
        for batch in batches:
            quotient = batch.column("quotient").to_numpy().astype(np.uint64)
            left = (quotient << np.uint64(h - q)) | batch.column("rem_hi").to_numpy().view(np.uint64)
            right = batch.column("rem_lo").to_numpy().view(np.uint64)
            left, right = perm.backward(left, right)
            b = np.uint64(bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array((left >> b).astype(np.int64)), pa.array((left & mask).astype(np.int64)),
                 pa.array(((right >> b) & mask).astype(np.int64)), pa.array((right & mask).astype(np.int64)), batch.column("f")],
                names=["lang", "order", "w1", "w2", "w3", "f"])
    return run


def _dense_ids(words: DataFrame, own: list) -> DataFrame:
    """word → id 1 … V without one task: ids from per-partition counts and offsets."""
    words = settled(words.select("word", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mono")), "vocab", own)
    counts = words.groupBy("part").agg(F.count("*").alias("n"))       # one row per partition: a proven bound
    offsets = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    ids = words.join(F.broadcast(offsets), "part").select(
        "word", (F.col("offset") + F.col("mono") - F.shiftleft(F.col("part").cast("long"), 33) + 1).alias("id"))
    return settled(ids, "vocab-ids", own)


def collocations(docs: DataFrame, top: int = 2000, min_count: int = 10, share: int = 50) -> DataFrame:
    """Each lang's `top` phrases of 2 or 3 words by score desc, a desc, phrase asc: lang, rank, phrase, a, l, r, n, score.

    a = f(phrase) ≥ `min_count`; f counts all contiguous occurrences inside pieces, overlaps included. For every cut
    after k words, l = f(first part), r = f(rest), score = floor(10^6 a² / (l r)); the lowest score counts, ties to the
    smallest k. A candidate lying contiguously inside a longer candidate with 100 f(longer) ≥ `share` a is dropped.
    n = all word occurrences of the lang. Null texts are empty, null langs `und`; empty tables, very long texts,
    repeated rows and extra columns of any name are fine (only text and lang are read).
    """
    spark = docs.sparkSession
    own: list[str] = []
    slim = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.make_valid_utf8(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    flat = slim.mapInArrow(released(_counted), "lang string, word string, f long")
    counted = settled(flat.groupBy("lang", "word").agg(F.sum("f").alias("f")), "word-counts", own)
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counted.where(F.col("f") >= min_count).select("word").distinct()
    stats = frequent.agg(F.count("*").alias("v"), F.coalesce(F.sum(F.octet_length("word") + 16), F.lit(0)).alias("b")).first()
    bits = max(2, int(stats["v"] + 1).bit_length())

    if stats["b"] <= BROADCAST_BYTES:
        vocab = pa.array(sorted(r.word for r in frequent.collect()), pa.string())     # a counted, bounded size
        ids = spark.createDataFrame([(w, i + 1) for i, w in enumerate(vocab.to_pylist())], "word string, id long") if len(vocab) else None
        streams = slim.mapInArrow(released(_to_ids(vocab)), "lang string, ids array<int>")
    else:
        ids = _dense_ids(frequent, own)
        stream = pieces(docs).select("lang", F.monotonically_increasing_id().alias("doc"), F.posexplode("words").alias("piece", "ws"))
        stream = settled(stream.select("lang", "doc", "piece", F.posexplode("ws").alias("pos", "word")), "stream", own)
        joined = stream.join(ids, "word", "left").select("lang", "doc", "piece", "pos", F.coalesce("id", F.lit(0)).alias("id"))
        per_piece = joined.groupBy("lang", "doc", "piece").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("s"))
        streams = per_piece.select("lang", F.concat(F.col("s.id"), F.array(F.lit(0).cast("long"))).alias("ids"))
    streams = settled(streams, "id-streams", own)          # 4 or 8 bytes a word, read twice below

    kinds = "lang string, quotient long, rem_hi long, rem_lo long, f long"
    grams_schema = "lang string, order long, w1 long, w2 long, w3 long, f long"

    def counted_grams(orders, pairs, name):
        merged = streams.mapInArrow(released(_filters(bits, orders, pairs)), kinds).groupBy("lang", "quotient", "rem_hi", "rem_lo") \
            .agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
        return settled(merged.mapInArrow(released(_inverse(bits)), grams_schema), name, own)

    short = counted_grams((1, 2), None, "grams-12")
    # a 3-gram can reach min_count only if both of its 2-grams do: those pairs are sent along when their count allows
    frequent_pairs = short.where("order = 2")
    n_pairs = frequent_pairs.count()
    pairs = None
    if n_pairs * 16 <= BROADCAST_BYTES:
        got = frequent_pairs.select("w1", "w2").toArrow()
        pairs = np.sort((got.column("w1").to_numpy().astype(np.uint64) << np.uint64(bits)) | got.column("w2").to_numpy().astype(np.uint64))
    grams = short.unionByName(counted_grams((3,), pairs, "grams-3"))

    def count_of(order: int, *cols: str, name: str) -> DataFrame:
        keys = ["w1", "w2", "w3"][:order]
        g = grams.where(F.col("order") == order).select("lang", *[F.col(k).alias(c) for k, c in zip(keys, cols)], F.col("f").alias(name))
        return g

    cand = grams.where((F.col("order") >= 2)).select("lang", "order", "w1", "w2", "w3", F.col("f").alias("a"))
    dec = "decimal(38,0)"

    def score(a, l, r):
        return F.expr(f"cast(1000000 as {dec}) * cast({a} as {dec}) * cast({a} as {dec}) div (cast({l} as {dec}) * cast({r} as {dec}))")

    two = cand.where("order = 2").join(count_of(1, "w1", name="l"), ["lang", "w1"]).join(count_of(1, "w2", name="r"), ["lang", "w2"])
    two = two.select("lang", "order", "w1", "w2", "w3", "a", "l", "r", score("a", "l", "r").alias("score"))
    three = (cand.where("order = 3")
             .join(count_of(1, "w1", name="l1"), ["lang", "w1"]).join(count_of(2, "w2", "w3", name="r1"), ["lang", "w2", "w3"])
             .join(count_of(2, "w1", "w2", name="l2"), ["lang", "w1", "w2"]).join(count_of(1, "w3", name="r2"), ["lang", "w3"]))
    s1, s2 = score("a", "l1", "r1"), score("a", "l2", "r2")
    first = s1 <= s2
    three = three.select("lang", "order", "w1", "w2", "w3", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                         F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least(s1, s2).alias("score"))
    longer = cand.where("order = 3")
    covers = (longer.select("lang", "w1", "w2", "a").union(longer.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
              .groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer")))
    two = two.join(covers, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).drop("longer")
    scored = settled(two.unionByName(three), "scored", own)

    # the phrase text: ids back to words (only the candidates' words travel)
    vocab_ids = ids if ids is not None else spark.createDataFrame([], "word string, id long")
    named = scored
    for k in ("w1", "w2", "w3"):
        named = named.join(vocab_ids.select(F.col("id").alias(k), F.col("word").alias(k + "_s")), k, "left")
    named = named.select("lang", F.concat_ws(" ", "w1_s", "w2_s", "w3_s").alias("phrase"), "a", "l", "r", F.col("score").cast("long").alias("score"))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = named.withColumn("salt", F.abs(F.xxhash64("phrase")) % 64)      # a lang's top k found in 64 parts first
    near = salted.withColumn("k", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("k") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = settled(out, "collocations")
    drop_tables(spark, own)
    return out
