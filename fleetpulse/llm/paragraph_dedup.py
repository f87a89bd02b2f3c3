"""Repeated passages: paragraphs by prefix keys, MinHash banding and exact Jaccard, sentences inside paragraphs by their digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import by_bytes, drop_tables, mix, settled, text_buffers, word_hashes, word_spans
from fleetpulse.llm.minhash_dedup import near_duplicates

MIN_WORDS = 5               # a removed paragraph or run of sentences has at least as many words: one shingle
SENTENCE_WORDS = 5          # shorter sentences are no evidence; a run goes over them
BANDS, ROWS = 40, 6         # as for whole documents: a pair at Jaccard 0.8 shares no band with a chance of 5e-6
SHORT = 160                 # paragraphs of up to so many shingles have keys that lose no pair, about a fifth of their shingles
MOST_LINES = 1 << 20        # paragraphs of one document that have an id of their own


def _lines(least: int):
    """Paragraphs (texts between line breaks) of at least `least` words: uid, bytes [start, stop), text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            ids, texts = [], []
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                for at, line in enumerate((batch.column("text")[k].as_py() or "").split("\n")):
                    if len(line) >= 2 * least - 1 and len(line.encode().split()) >= least:
                        if at >= MOST_LINES:
                            raise ValueError(f"doc_id {doc_id}: paragraph beyond line {MOST_LINES}")
                        ids.append(doc_id * MOST_LINES + at)
                        texts.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentences of at least SENTENCE_WORDS words: doc_id, place among them, bytes [start, stop), words, two digests.

    A sentence ends behind a word that ends in `.`, `!` or `?`, before a line break, and at the end of the text.
    """
    for batch in by_bytes(batches, "text"):
        raw, offsets = text_buffers(batch.column("text"))
        starts, ends, first = word_spans(raw, offsets)
        n = len(starts)
        close = np.isin(raw[ends - 1], np.frombuffer(b".!?", np.uint8)) if n else np.zeros(0, bool)
        lines = np.concatenate(([0], np.cumsum(raw == 10)))
        close |= np.concatenate((lines[starts[1:]] > lines[ends[:-1]], [True])) if n else False
        close[first[1:][np.diff(first) > 0] - 1] = True
        last = np.flatnonzero(close)
        begin = np.concatenate(([0], last[:-1] + 1)).astype(np.int64) if len(last) else last
        size = last - begin + 1
        words = word_hashes(raw, starts, ends)
        place = (np.arange(n) - np.repeat(begin, size)).astype(np.uint64)
        d1 = np.add.reduceat(mix(words + place * np.uint64(0x9E3779B97F4A7C15)), begin) if len(begin) else np.zeros(0, np.uint64)
        d2 = np.add.reduceat(mix((words ^ np.uint64(0xA5A5A5A5)) * np.uint64(3) + mix(place)), begin) if len(begin) else np.zeros(0, np.uint64)
        keep = np.flatnonzero(size >= SENTENCE_WORDS)
        doc = np.searchsorted(first, begin[keep], "right") - 1
        at = np.arange(len(keep)) - np.searchsorted(doc, doc)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(doc)), pa.array(at.astype(np.int32)), pa.array((starts[begin[keep]] - offsets[doc]).astype(np.int64)),
             pa.array((ends[last[keep]] - offsets[doc]).astype(np.int64)), pa.array(size[keep].astype(np.int32)),
             pa.array(d1[keep].view(np.int64)), pa.array(d2[keep].view(np.int64))],
            names=["doc_id", "at", "start", "stop", "words", "d1", "d2"])


def _runs(least: int):
    """Repeated sentences of a document (list of structs) → byte spans of its runs of at least `least` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column("rows").to_pylist():
                spans: list[list[int]] = []
                for r in sorted(rows, key=lambda r: r["at"]):
                    if spans and r["at"] == spans[-1][3] + 1:
                        spans[-1][1:] = [r["stop"], spans[-1][2] + r["words"], r["at"]]
                    else:
                        spans.append([r["start"], r["stop"], r["words"], r["at"]])
                out.append([{"start": s[0], "stop": s[1]} for s in spans if s[2] >= least])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "runs"])
    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte spans of runs and of whole paragraphs (by their number) → merged spans and what is left of the text."""
    for batch in batches:
        spans_out, kept = [], []
        for text, runs, lines in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), batch.column("lines").to_pylist()):
            raw = (text or "").encode()
            spans = [(r["start"], r["stop"]) for r in runs or []]
            if lines:
                ends = np.flatnonzero(np.frombuffer(raw + b"\n", np.uint8) == 10)
                spans += [(int(ends[k - 1]) + 1 if k else 0, int(ends[k])) for k in lines]
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            left, at = [], 0
            for a, b in merged:
                left.append(raw[at:a])
                at = b
            kept.append((b"".join([*left, raw[at:]])).decode())
            spans_out.append([{"start": a, "stop": b} for a, b in merged])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans_out, kind), pa.array(kept, pa.string())], names=["doc_id", "removed", "text"])


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, percent: int = 80, width: int = 5) -> DataFrame:
    """Documents of `docs` (doc_id, text) that lose something: doc_id, removed (byte spans), text (what is left).

    Of each group of repeated paragraphs the first stays, by doc_id and place; the others are removed:
    * paragraphs (between line breaks, at least `least` words, by default all that have a shingle) whose sets of `width`-word shingles have a Jaccard
      similarity of at least `percent` / 100, found by prefix keys or banding, verified on full sets, grouped by components;
    * runs of sentences, each at least SENTENCE_WORDS words and equal to an earlier one, of `least` words together: the
      passages that stand inside other paragraphs, where a paragraph's set says nothing.

    Digests are counted before they are exchanged and bring back one row each, so a line that stands everywhere is never
    gathered. Null texts are empty; rows with a null doc_id, and documents that lose nothing, are not in the result;
    doc_id is expected to be unique and to lie within ±2^42, paragraphs within the first 2^20 lines (else an error); other columns are ignored; an empty table
    gives an empty result.
    """
    own: list[str] = []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    safe = F.when(F.abs("doc_id") < (1 << 42), F.col("doc_id")).otherwise(F.raise_error(F.lit("doc_id beyond 2^42")))
    lines = docs.withColumn("doc_id", safe).mapInArrow(_lines(least), "doc_id long, text string")
    groups = near_duplicates(lines, width, percent, BANDS, ROWS, SHORT)
    extra = groups.where("not kept").select(F.floor(F.col("doc_id") / MOST_LINES).cast("long").alias("doc_id"), F.pmod("doc_id", F.lit(MOST_LINES)).cast("int").alias("line"))
    extra = extra.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))

    units = settled(docs.mapInArrow(_units, "doc_id long, at int, start long, stop long, words int, d1 long, d2 long"), "sentences", own)
    firsts = units.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.count("*").alias("n")).where("n > 1")
    again = units.join(firsts, ["d1", "d2"]).where("doc_id <> f.doc_id or at <> f.at")
    again = again.groupBy("doc_id").agg(F.collect_list(F.struct("at", "start", "stop", "words")).alias("rows"))
    runs = again.mapInArrow(_runs(least), "doc_id long, runs array<struct<start:long,stop:long>>").where("size(runs) > 0")
    hit = settled(runs.join(extra, "doc_id", "full"), "spans", own)
    out = settled(docs.join(hit, "doc_id").mapInArrow(_finish, "doc_id long, removed array<struct<start:long,stop:long>>, text string"), "passages")
    drop_tables(docs.sparkSession, own)
    return out


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """All rows and columns of `docs` with repeated passages taken out of `text`."""
    found = repeated_passages(docs, **options).select("doc_id", F.col("text").alias("__left"))
    out = docs.join(found, "doc_id", "left").withColumn("text", F.coalesce("__left", "text"))
    return out.select(*docs.columns)
