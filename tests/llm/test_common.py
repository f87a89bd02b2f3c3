"""Scratch tables send small batches to Python."""
import pyarrow as pa
from pyspark.sql import functions as F

from fleetpulse.llm import common


def test_batches_follow_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    before = spark.conf.get(common.ARROW_BYTES)
    wide = spark.range(0, 4000, 1, 1).withColumn("text", F.repeat(F.lit("x"), 4000))
    got = [r.n for r in common.settled(wide.mapInArrow(sizes, "n long"), "wide").collect()]
    assert len(got) > 2 and max(got) <= 2 * common.BATCH_BYTES and sum(got) > 4000 * 4000
    assert spark.conf.get(common.ARROW_BYTES) == before


def test_smaller_batches_stay(spark):
    before = spark.conf.get(common.ARROW_BYTES)
    try:
        spark.conf.set(common.ARROW_BYTES, "1m")
        with common.small_batches(spark):
            assert spark.conf.get(common.ARROW_BYTES) == "1m"
    finally:
        spark.conf.set(common.ARROW_BYTES, before)
