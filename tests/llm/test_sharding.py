"""Shards by global prefix sums: against a plain sort and cumulative sum in Python."""
import zlib

import pytest

from fleetpulse.llm import sharding
from odd_tables import LONG, none, odd  # noqa: F401


def brute(rows, shards, law, overhead=16):
    keyed = []
    for doc_id, text in rows:
        body = (text or "").encode()
        keyed.append((doc_id is not None, doc_id if doc_id is not None else 0, zlib.crc32(body), len(body) + overhead, doc_id))
    keyed.sort()
    weights = [k[3] if law == "bytes" else 1 for k in keyed]
    total, start, out, seen = sum(weights), 0, [], {}
    for k, w in zip(keyed, weights):
        shard = min(shards - 1, ((2 * start + w) * shards) // (2 * total) if law == "bytes" else (start * shards) // total)
        out.append((k[4], k[3], k[2], shard, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + 1
        start += w
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1], r[3], r[4]))


def got(df):
    rows = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1], r[3], r[4]))


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_odd_rows_match_brute_force(odd, law):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    out = sharding.shard_plan(odd, shards=5, law=law)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert got(out) == brute(rows, 5, law)
    assert {r.law for r in out.select("law").collect()} == {law}


def test_documents_balanced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = sharding.shard_plan(docs, shards=40)
    assert got(out) == brute(rows, 40, "bytes")
    sizes = {r.shard: r.b for r in out.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()}
    largest = max(len((t or "").encode()) + 16 for _, t in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_hot_copies_are_split(spark):
    """A third of the rows are one repeated row; they still spread over shards, each slot run gapless."""
    rows = [(7, "same text")] * 300 + [(i, "x" * (i % 50)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_plan(df, shards=10, law="rows")
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(counts) == 10 and max(counts) - min(counts) <= 1
    assert got(out) == brute(rows, 10, "rows")


def test_empty_table(none):
    assert sharding.shard_plan(none).count() == 0
