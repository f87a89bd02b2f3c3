"""The chunked layout must give exactly the rows of the plain one, also when one key holds most rows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conftest import rows
from fleetpulse.catalog.views import READINGS
from fleetpulse.operators import features as ft
from fleetpulse.operators import ordering as od
from fleetpulse.plans.fused import fused_frame


@pytest.fixture(scope="module")
def skewed(readings):
    """One system holds over a third of all rows, many of them at one instant."""
    hot = F.col("event_id") % 5 < 2
    return readings.withColumn("system_id", F.when(hot, F.lit("HOT")).otherwise(F.col("system_id"))).withColumn(
        "ts", F.when(F.col("event_id") % 10 == 1, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("ts")))


def test_number_rows_is_dense_and_ordered(skewed):
    out = od.number_rows(skewed.select("system_id", "ts", "event_id"), ["system_id", "ts", "event_id"], "pos")
    want = W.orderBy("system_id", "ts", "event_id")
    assert out.withColumn("rn", F.row_number().over(want) - 1).where("rn <> pos").count() == 0


@pytest.mark.parametrize("chunk", [12, 64])
def test_fused_frame_layouts_agree(skewed, chunk):
    plain = fused_frame(skewed, READINGS, layout="plain")
    chunked = fused_frame(skewed, READINGS, layout="chunked", chunk_rows=chunk)
    assert rows(plain, 6) == rows(chunked, 6)


def test_hot_keys_are_split_off(spark, skewed):
    spark.conf.set("spark.fleetpulse.oneTaskBytes", "1")
    try:
        auto = ft.rate_of_change(skewed, READINGS, max_rows=100, chunk_rows=50)
        assert rows(auto) == rows(ft.rate_of_change(skewed, READINGS, layout="plain"))
    finally:
        spark.conf.unset("spark.fleetpulse.oneTaskBytes")


def test_positions_layouts_agree(skewed):
    args = (skewed.select("system_id", "ts", "event_id"), "system_id", ["ts", "event_id"])
    assert rows(od.positions(*args, layout="plain")) == rows(od.positions(*args, layout="chunked"))


def test_running_totals_layouts_agree(skewed):
    df = skewed.groupBy("system_id", F.round("speed").alias("v")).count()
    args = (df, "system_id", [F.col("v").desc()], {"upto": "count"})
    assert rows(od.running_totals(*args, layout="plain")) == rows(
        od.running_totals(*args, layout="chunked", chunk_rows=7))


def test_fill_layouts_agree(skewed):
    gappy = skewed.select("system_id", "ts", "event_id",
                          F.when(F.col("event_id") % 7 == 0, F.col("speed")).alias("a"),
                          F.when(F.col("event_id") % 31 == 0, F.col("voltage")).alias("b"))
    args = (gappy, "system_id", ["ts", "event_id"], ["a", "b"])
    assert rows(od.fill_missing(*args, layout="plain")) == rows(
        od.fill_missing(*args, layout="chunked", chunk_rows=5))


def test_quantile_layouts_agree(skewed):
    args = (skewed, "fault_type", "battery_level", [0, 0.1, 0.25, 0.5, 0.77, 1])
    assert rows(od.quantiles(*args, layout="plain")) == rows(od.quantiles(*args, layout="chunked"))


def test_fused_frame_plan_has_one_hash_exchange(readings):
    text = fused_frame(readings, READINGS)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(") == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_split_compares_in_the_row(spark):
    """The wide table is neither exchanged nor sorted, and the rows are those of the window; equal keys across a cut go to it."""
    from pyspark.sql import functions as F

    from fleetpulse.operators import prepare as pr

    df = spark.range(3000).select(F.when(F.col("id") % 700 > 0, F.col("id")).alias("k"), (F.col("id") % 3).cast("string").alias("label"),
                                  F.rand(1).alias("x"))
    plan = pr.stratified_split(df, "label", "k", 0.2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    copies = df.unionByName(df).unionByName(df)
    unlabelled = df.withColumn("label", F.when(F.col("label") != "1", F.col("label")))
    for table, share in ((df, 0.2), (copies, 0.33), (unlabelled, 0.2), (df, 0.0)):
        got, want = ({tuple(r) for r in pr.stratified_split(table, "label", "k", share, layout=layout).groupBy(
            "label", "k", "split").count().collect()} for layout in ("auto", "plain"))
        assert got == want
