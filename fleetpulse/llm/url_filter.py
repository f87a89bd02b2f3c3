"""URL rules in sorted arrays of 64-bit digests: memory-mapped, probed by binary search, confirmed on the stored strings."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.session import scratch_path

PART_RULES = 1_000_000      # rules of one array; more rules make more arrays, probed one after another


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules (part, rule, block), sorted by part → one row per part: digests, ends of the strings, flags, strings."""
    part, rules, flags = None, [], []

    def out() -> pa.RecordBatch:
        keys = np.array([digest(r) for r in rules], np.uint64)
        order = np.argsort(keys, kind="stable")
        raw = [rules[k].encode() for k in order]
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        flag = np.array(flags, np.uint8)[order]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(rules)], pa.int64())]
                                          + [pa.array([x], pa.binary()) for x in (keys[order].tobytes(), ends.tobytes(), flag.tobytes(), b"".join(raw))],
                                          names=["part", "n", "keys", "ends", "flags", "strings"])
    for batch in batches:
        for p, rule, block in zip(*(batch.column(c).to_pylist() for c in ("part", "rule", "block"))):
            if rules and p != part:
                yield out()
                rules, flags = [], []
            part = p
            rules.append(rule)
            flags.append(block)
    if rules:
        yield out()


class DigestArray:
    """One part, mapped from a local file. Several rules may share a digest; the stored string decides."""

    def __init__(self, path: str):
        row = pq.read_table(path, columns=["keys", "ends", "flags", "strings"])
        folder = tempfile.mkdtemp(prefix="digests-")
        arrays = []
        for name, kind in (("keys", np.uint64), ("ends", np.int64), ("flags", np.uint8), ("strings", np.uint8)):
            at = os.path.join(folder, name)
            with open(at, "wb") as f:
                for value in row.column(name):
                    f.write(value.as_buffer())
            arrays.append(np.memmap(at, kind, "r") if os.path.getsize(at) else np.zeros(0, kind))
        self.keys, self.ends, self.flags, self.strings = arrays

    def probe(self, rules: list[str]) -> np.ndarray:
        """For each string: -1 unknown, 0 allowed, 1 blocked."""
        keys = np.array([digest(r) for r in rules], np.uint64)
        out = np.full(len(rules), -1, np.int8)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for k in np.flatnonzero(high > low):
            for at in range(low[k], high[k]):
                start = int(self.ends[at - 1]) if at else 0
                if self.strings[start : int(self.ends[at])].tobytes() == rules[k].encode():
                    out[k] = self.flags[at]
        return out


_OPEN: dict[str, DigestArray] = {}


def _opened(name: str) -> DigestArray:
    if name not in _OPEN:
        _OPEN[name] = DigestArray(SparkFiles.get(name))
    return _OPEN[name]


def write_index(rules: DataFrame) -> str:
    """Rules (host, path, action 'allow' or 'block') → a folder of one file per part; of equal rules a block wins.

    Rules that can fit nothing are left out: no host, a null column, a path that neither is empty nor begins with `/`.
    Hosts are lower-cased (A-Z).
    """
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rules.select(host.alias("host"), "path", F.col("action")).where("length(host) > 0 and (path = '' or startswith(path, '/')) and action is not null")
    rows = rows.groupBy("host", "path").agg(F.max((F.col("action") == "block").cast("int")).alias("block"))
    parts = max(-(-rows.count() // PART_RULES), 1)
    rows = rows.select(F.concat("host", "path").alias("rule"), "block")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rule"), F.lit(parts)).cast("int"))
    rows = rows.repartition("part").sortWithinPartitions("part")
    folder = scratch_path(rules.sparkSession, "digests")
    rows.mapInArrow(_pack, "part int, n long, keys binary, ends binary, flags binary, strings binary").write.partitionBy("part").parquet(folder)
    return folder


def split_url(url: str) -> tuple:
    """Host and path as columns; both empty for null or without `://`."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of `pages` (page_id, url).

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest host + path wins, at
    equal length the longer host. Without a rule the verdict is `default`: what is not listed is not blocked. A map over
    the rows: the arrays go to every executor as files and are memory-mapped there, so their size costs disk, not
    memory. Null urls and urls without `://` have empty host and path; null ids and repeated rows stay; other columns are
    ignored; empty tables and empty rule lists are fine.
    """
    spark = pages.sparkSession
    lengths = sorted((r[0] for r in rules.select(F.length("path")).where("path is not null").distinct().collect()), reverse=True)
    files = []
    for uri in spark.read.schema("n long, keys binary").parquet(write_index(rules)).inputFiles():
        spark.sparkContext.addFile(uri)
        files.append(os.path.basename(uri))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [_opened(f) for f in files]
        for batch in batches:
            hosts, paths = (batch.column(c).to_pylist() for c in ("host", "path"))
            asked, owner = [], []
            for k, (host, path) in enumerate(zip(hosts, paths)):
                names = host.split(".")
                for a in range(len(names)):
                    suffix = ".".join(names[a:])
                    if suffix:
                        asked += [(suffix, path[:n]) for n in lengths if n <= len(path)]
                owner += [k] * (len(asked) - len(owner))
            found: list[tuple] = [(-1, -1, None, default)] * len(hosts)
            text = [h + p for h, p in asked]
            for array in arrays if asked else []:
                flags = array.probe(text)
                for at in np.flatnonzero(flags >= 0):
                    host, path = asked[at]
                    mine = (len(host) + len(path), len(host), text[at], "block" if flags[at] else "allow")
                    if mine[:2] > found[owner[at]][:2]:
                        found[owner[at]] = mine
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.string())],
                                             names=[*batch.schema.names, "rule", "verdict"])

    host, path = split_url("url")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    slim = slim.select("page_id", host.alias("host"), path.alias("path"))
    return slim.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
