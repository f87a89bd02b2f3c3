"""Imbalanced tables composed from a larger one, and the catalogue of known tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators.ordering import positions
from fleetpulse.operators.prepare import hash_key
from fleetpulse.schema import ReadingSchema

BASE_TIME = "2025-01-01 00:00:00"

# Catalogue slugs and titles.
TITLES = {
    "quickstart": "Quickstart demo",
    "fleet_10x": "Production fleet (10 systems)",
    "mostly_healthy": "Mostly healthy fleet",
    "rare_critical": "Rare critical events",
    "long_degradation": "Long degradation (RUL)",
    "noisy_environment": "Noisy environment",
    "cmapss_fd001": "NASA CMAPSS FD001 (real data)",
    "cmapss_fd002": "NASA CMAPSS FD002 (real, multi-condition)",
    "cmapss_fd004": "NASA CMAPSS FD004 (real, hardest)",
    "ai4i_2020": "UCI AI4I 2020 (real, industrial machinery)",
}

_READERS: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register_dataset(slug: str, reader: Callable[[SparkSession], DataFrame]) -> None:
    _READERS[slug] = reader


def load_dataset(spark: SparkSession, slug: str) -> DataFrame:
    if slug not in _READERS:
        raise ValueError(f"unknown dataset: {slug}")
    return _READERS[slug](spark)


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def take_per_class(df: DataFrame, schema: ReadingSchema, counts: dict[str, int], seed: int) -> DataFrame:
    """The first `counts[class]` rows of each class in a seeded order, numbered in `pick`.

    One bounded top-n per class: tasks keep n candidates each, so a huge class is never sorted.
    """
    parts = []
    for name, n in counts.items():
        top = df.where(F.col(schema.label) == name).withColumn("__h", hash_key(schema.tie, seed))
        parts.append(top.orderBy("__h", schema.tie).limit(n))
    # at most sum(counts) rows from here on
    return positions(union_sources(*parts), schema.label, ["__h", schema.tie], "pick", "__n", "plain").drop("__h", "__n")


def restamp(df: DataFrame, order: list[str | Column], ts: str, start: str = BASE_TIME, seconds: int = 1,
            layout: str = "auto") -> DataFrame:
    """New timestamps, `seconds` apart in the given order over the whole table."""
    placed = positions(df.withColumn("__all", F.lit(0)), "__all", order, "__i", "__n", layout)
    at = F.timestamp_seconds(F.unix_seconds(F.lit(start).cast("timestamp")) + F.col("__i") * seconds)
    return placed.withColumn(ts, at.cast(df.schema[ts].dataType)).drop("__all", "__i", "__n")


def standard_mixes(df: DataFrame, schema: ReadingSchema) -> dict[str, DataFrame]:
    """The four composed tables: fleet, mostly healthy, rare critical, long degradation."""
    classes = [r[0] for r in df.select(schema.label).distinct().orderBy(schema.label).collect()]
    fleet = take_per_class(df, schema, {c: 200 for c in classes}, 21)
    system = F.concat(F.lit("FLEET-"), F.lpad((F.floor(F.col("pick") / 20) + 1).cast("string"), 2, "0"))
    healthy = take_per_class(df, schema, {c: 800 if c == "Normal" else 25 for c in classes}, 31)
    rare = take_per_class(df, schema, {"Normal": 800, "Motor Overheating": 10, "Battery Fault": 10}, 41)
    sinking = take_per_class(df, schema, {"Normal": 600, "Sensor Drift": 600}, 51)
    named = lambda d, s: d.withColumn(schema.system, s if isinstance(s, Column) else F.lit(s)).drop("pick")
    return {
        "fleet_10x": named(fleet, system).orderBy(hash_key(schema.tie, 21)),
        "mostly_healthy": named(healthy, "PROD-01").orderBy(hash_key(schema.tie, 31)),
        "rare_critical": named(rare, "PROD-02").orderBy(schema.ts, schema.tie),
        "long_degradation": named(restamp(sinking, [schema.label, "pick"], schema.ts, layout="plain"), "RUL-01"),
    }


def dataset_catalog(spark: SparkSession, tables: dict[str, DataFrame | None], schema: ReadingSchema) -> DataFrame:
    """One row per known table with what was observed in it; None marks a table that is not there."""
    known = spark.createDataFrame([(s, TITLES.get(s, s)) for s in tables], "slug string, title string")
    seen = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(schema.system).alias("systems"),
               F.count_distinct(schema.label).alias("classes")).select(F.lit(slug).alias("slug"), "*")
        for slug, df in tables.items() if df is not None]
    if not seen:
        seen = [spark.createDataFrame([], "slug string, rows long, systems long, classes long")]
    out = known.join(union_sources(*seen), "slug", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("slug", "title", zero("rows"), zero("systems"), zero("classes"),
                      F.col("rows").isNotNull().alias("present"))
