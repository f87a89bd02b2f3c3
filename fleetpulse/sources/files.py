"""CSV, turbofan text, machining CSV and run-log readers; prediction writers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import nan_to_null
from fleetpulse.operators.explore import rul_cycle_label
from fleetpulse.schema import SENSORS, ReadingSchema
from fleetpulse.session import written

BASE_TIME = "2025-01-01 00:00:00"

# Layout of the public turbofan files and the sensor each reading is taken from.
TURBOFAN_COLUMNS = (["unit_id", "time_in_cycles"] + [f"op_setting_{i}" for i in range(1, 4)]
                    + [f"sensor_{i}" for i in range(1, 22)])
TURBOFAN_SENSORS = {
    "motor_temperature": "sensor_2", "battery_level": "sensor_9", "voltage": "sensor_14", "current": "sensor_3",
    "vibration_x": "sensor_11", "vibration_y": "sensor_12", "vibration_z": "sensor_13",
    "acceleration_x": "op_setting_1", "acceleration_y": "op_setting_2", "acceleration_z": "op_setting_3",
    "gps_accuracy": "sensor_7", "gps_satellite_count": "sensor_4", "signal_strength": "sensor_8",
    "altitude": "sensor_15", "speed": "sensor_17", "heading": "sensor_20",
}
# Machining failure codes, first match wins.
MACHINING_FAULTS = {
    "HDF": "Motor Overheating", "PWF": "Power Instability", "OSF": "Vibration Fault",
    "TWF": "Sensor Drift", "RNF": "Communication Fault",
}


def read_readings_csv(spark: SparkSession, path: str, schema: ReadingSchema = ReadingSchema()) -> DataFrame:
    """CSV with a header. Unreadable timestamps, numbers and NaN become NULL.

    Known columns get their type from the schema whatever else is in the file; only unknown columns are inferred, in a
    pass over the text. Without a tie-break column the readings get one: `row_key`. Raises on fewer than two columns
    or no rows.
    """
    names = spark.read.option("header", True).csv(path).columns if _has_text(spark, path) else []
    if len(names) < 2:
        raise ValueError("CSV must have at least two columns and one row")
    strings = {schema.ts, schema.system, schema.label}
    known = {*schema.sensors, schema.tie, *strings}
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("nanValue", "NaN")
    guessed = dict(reader.option("inferSchema", True).csv(path).dtypes) if set(names) - known else {}
    kind = lambda n: "string" if n in strings else "bigint" if n == schema.tie else "double" if n in known else guessed[n]
    df = reader.schema(", ".join(f"`{n}` {kind(n)}" for n in names)).csv(path)
    if df.isEmpty():
        raise ValueError("CSV must have at least two columns and one row")
    if schema.ts in names:
        df = df.withColumn(schema.ts, F.try_to_timestamp(F.col(schema.ts).cast("string")).cast("timestamp_ntz"))
    if schema.system not in names:
        df = df.withColumn(schema.system, F.lit("SYS-01"))
    return nan_to_null(df if schema.tie in names else df.withColumn(schema.tie, row_key()))


def row_key() -> Column:
    """A tie-break for the rows of files: the row's place in its task, then a hash of its file block. Equal for equal
    files and read settings; rows of one block keep their order."""
    block = F.pmod(F.xxhash64(F.input_file_name(), F.input_file_block_start()), F.lit(1 << 30))
    return F.shiftleft(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1), 30) + block


def _has_text(spark: SparkSession, path: str) -> bool:
    return not spark.read.text(path).isEmpty()


def adapt_turbofan(lines: DataFrame, healthy_cutoff: int = 50, seconds_per_cycle: float = 1.0) -> DataFrame:
    """Whitespace-separated lines (column `value`) → labelled readings. Parsing is all expressions and is done once: the
    parsed rows are written, for the label needs each unit's last cycle and a feature frame reads its input several times.

    The unit stands in system_id and the cycle in the time; neither is a column that a model could read the label from.
    row_id is unit · 2^20 + cycle, unique in well-formed files.
    """
    parts = F.split(F.trim("value"), r"\s+")
    wide = lines.where(F.trim("value") != "").select(parts.alias("p")).select(
        F.get("p", F.lit(0)).try_cast("double").cast("int").alias("unit"),
        F.get("p", F.lit(1)).try_cast("double").cast("int").alias("cycle"),
        *[F.get("p", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(TURBOFAN_COLUMNS) if i >= 2])
    labelled = rul_cycle_label(written(nan_to_null(wide), "turbofan-rows"), "unit", "cycle", healthy_cutoff)
    unit = F.col("unit").cast("string")
    base = F.unix_micros(F.lit(BASE_TIME).cast("timestamp"))
    at = F.timestamp_micros(base + (F.col("cycle") * seconds_per_cycle * 1e6).cast("long")).cast("timestamp_ntz")
    return labelled.select(
        (F.col("unit").cast("long") * (1 << 20) + F.col("cycle")).alias("row_id"), at.alias("timestamp"), F.concat(F.lit("CMAPSS-"), F.when(F.length(unit) < 3, F.lpad(unit, 3, "0")).otherwise(unit)).alias("system_id"),
        *[(F.col(TURBOFAN_SENSORS[s]) if TURBOFAN_SENSORS[s] in labelled.columns else F.lit(0.0)).alias(s) for s in SENSORS],
        "fault_type")


def machining_label(df: DataFrame) -> Column:
    label = F.lit("Normal")
    for code, fault in reversed(MACHINING_FAULTS.items()):
        if code in df.columns:
            label = F.when(F.col(code) == 1, fault).otherwise(label)
    failed = F.coalesce(F.col("`Machine failure`"), F.lit(0)) if "Machine failure" in df.columns else F.lit(0)
    return F.when(failed == 0, "Normal").otherwise(label)


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lstrip("﻿").strip() for c in df.columns])


def adapt_machining(raw: DataFrame, seconds_per_row: int = 60) -> DataFrame:
    """Milling records → labelled readings. Columns the source lacks hold their typical value.

    The two global statistics enter as one scalar row, the time comes from the record number: no global window.
    """
    df = clean_headers(raw)
    num = lambda c: F.col(f"`{c}`").cast("double")
    rpm, torque = num("Rotational speed [rpm]"), num("Torque [Nm]")
    stats = df.agg(F.struct(F.avg(rpm).alias("rm"), F.stddev_samp(rpm).alias("rs"), F.avg(torque).alias("tm"),
                            F.stddev_samp(torque).alias("ts"))).scalar()
    df = df.withColumn("__s", stats)
    s = F.col("__s")
    zr, zt = (rpm - s["rm"]) / s["rs"], (torque - s["tm"]) / F.greatest(s["ts"], F.lit(1e-6))
    wear = num("Tool wear [min]")
    battery = F.when(wear.isNotNull(), F.least(F.greatest(100.0 - wear * 0.4, F.lit(20.0)), F.lit(100.0)))
    udi = F.col("UDI").cast("long")
    base = F.unix_seconds(F.lit(BASE_TIME).cast("timestamp"))
    return df.select(
        udi.alias("row_id"), F.timestamp_seconds(base + (udi - 1) * seconds_per_row).cast("timestamp_ntz").alias("timestamp"),
        F.concat(F.lit("AI4I-TYPE-"), F.col("Type").cast("string")).alias("system_id"),
        (num("Process temperature [K]") - 273.15).alias("motor_temperature"), battery.alias("battery_level"),
        (23.5 + zr * 0.4).alias("voltage"), (11.0 + zt * 1.5).alias("current"),
        F.abs(0.15 + zt * 0.05).alias("vibration_x"), F.lit(0.15).alias("vibration_y"), F.lit(0.15).alias("vibration_z"),
        F.lit(0.0).alias("acceleration_x"), F.lit(0.0).alias("acceleration_y"), F.lit(9.81).alias("acceleration_z"),
        F.lit(2.0).alias("gps_accuracy"), F.lit(12.0).alias("gps_satellite_count"), F.lit(-60.0).alias("signal_strength"),
        (num("Air temperature [K]") - 273.15).alias("altitude"), (rpm / 100.0).alias("speed"), F.lit(180.0).alias("heading"),
        machining_label(df).alias("fault_type"))


RUN_SCHEMA = ("run_id string, kind string, timestamp string, params map<string,string>, "
              "metrics map<string,string>, extra map<string,string>")


def append_run(spark: SparkSession, path: str, kind: str, params: dict, metrics: dict, extra: dict | None = None) -> str:
    """Append one entry to the run log folder; returns its id."""
    run_id = uuid.uuid4().hex[:12]
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    entry = {"run_id": run_id, "kind": kind, "timestamp": stamp, "params": params, "metrics": metrics, "extra": extra or {}}
    spark.createDataFrame([(json.dumps(entry, default=str),)], "value string").write.mode("append").text(path)
    return run_id


def read_runs(spark: SparkSession, path: str, metrics: Sequence[str] | None = None,
              params: Sequence[str] | None = None) -> DataFrame:
    """The run log, newest first, one column `metric.k` / `param.k` per key; malformed lines are skipped.

    Keys become columns by map look-up, so nothing is shuffled; unknown key sets cost one pass over the map keys.
    """
    runs = spark.read.schema(RUN_SCHEMA).option("mode", "DROPMALFORMED").json(path).where(F.col("run_id").isNotNull())
    keys = lambda c: sorted(r[0] for r in runs.select(F.explode(F.map_keys(c)).alias("k")).distinct().collect())
    metrics = keys("metrics") if metrics is None else metrics
    params = keys("params") if params is None else params
    return runs.select(
        "run_id", "kind", "timestamp", *[F.try_element_at("metrics", F.lit(k)).alias(f"metric.{k}") for k in metrics],
        *[F.try_element_at("params", F.lit(k)).alias(f"param.{k}") for k in params]).orderBy(F.desc("timestamp"), "run_id")


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> str:
    """Predictions, metrics or datasets as CSV, JSON or Parquet; one file per task."""
    writer = df.write.mode(mode)
    if fmt != "parquet":  # text formats: keep microseconds
        micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
        writer = writer.option("header", True).option("timestampFormat", micros).option("timestampNTZFormat", micros)
    writer.format(fmt).save(path)
    return path

