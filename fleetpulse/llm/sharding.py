"""Contiguous balanced shards: global prefix sums of byte sizes from per-partition totals, cut at equal targets.

Everything here is DataFrame functions (the main path is native): no Python workers, no rows through the driver.

The documents are put in one total order — doc_id (nulls first), the text's crc32, its size, then a row number that
tells repeated rows apart — and range-partitioned on it, so that a doc_id or a text that stands in a third of all rows
is still cut across many tasks. Only the narrow columns travel: the texts are read once for their size and checksum.
Per range partition the sizes are summed; these P totals (one row per partition, bounded by the number of partitions,
not by the data) give each partition its offset; inside a partition a running sum gives each row the bytes before it.
A row belongs to the shard in which the middle of its bytes lies, so shards are contiguous runs of the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import drop_tables, settled

PARTITION_ROWS = 4_000_000          # narrow rows of ~40 bytes: some 160 MB a range partition
LAWS = ("bytes", "rows")


def shard_plan(docs: DataFrame, shards: int = 40, law: str = "bytes", overhead: int = 16, keep: list | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law is not `key`).

    size = UTF-8 bytes of `text` (null: 0) + `overhead`; text_crc32 = unsigned crc32 of those bytes (null: of none, 0).
    law `bytes`: a row's shard is floor(shards · (bytes before it + size / 2) / all bytes), so every shard's size is
    within one row's size of all bytes / shards (a row longer than that may leave a neighbouring shard empty).
    law `rows`: shard = floor(shards · rows before it / all rows): counts at most one apart.
    slot numbers the rows of a shard from 0 in the order above, gapless. Repeated rows, equal texts, null ids and texts,
    an empty table (no rows) and further columns of any name are fine; only doc_id and text are read.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    own: list[str] = []
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
                         F.crc32(body).cast("long").alias("text_crc32"),
                         F.monotonically_increasing_id().alias("row"))
    narrow = settled(narrow, "shard-rows", own)     # fixes the row numbers and cuts the scan's lineage
    order = [F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "row"]

    n_rows = narrow.count()
    parts = max(1, -(-n_rows // PARTITION_ROWS))
    ranged = narrow.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged = settled(ranged, "shard-ranges", own)

    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    totals = ranged.groupBy("part").agg(F.sum(weight).alias("part_total"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    offsets = totals.select("part",
                            F.coalesce(F.sum("part_total").over(before), F.lit(0)).alias("offset"),
                            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
                            F.sum("part_total").over(everything).alias("total"))
    # one row per range partition: a proven bound, so it is sent to every task
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("w", weight).join(F.broadcast(offsets), "part")
    placed = placed.select("doc_id", "size", "text_crc32", "row", "part",
                           (F.col("offset") + F.sum("w").over(inside) - F.col("w")).alias("start"),
                           (F.col("rows_before") + F.row_number().over(inside) - 1).alias("rank"), "w", "total")
    if law == "bytes":   # middle of the row's bytes, in halves to stay in whole numbers
        cut = F.expr(f"((start * 2 + w) * {shards}) div (total * 2)")
    else:
        cut = F.expr(f"(start * {shards}) div total")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), cut).cast("int"))
    placed = settled(placed.drop("w", "total"), "shard-placed", own)

    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))      # at most `shards` rows
    out = placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard",
        (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    out = settled(out, "shards", keep)
    drop_tables(spark, own)
    return out

