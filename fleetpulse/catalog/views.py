"""Readings and class scores derived from the driver tables; one text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.schema import SENSORS, ReadingSchema

READINGS = ReadingSchema(ts="ts", tie="event_id")
CLASSES = ["Battery Fault", "GPS Fault", "Motor Overheating", "Normal", "Sensor Drift"]
DRIFT_SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"


def _u(p: int) -> str:
    return f"(CAST(((event_id % 1009) * {p}) % 1009 AS DOUBLE) / 1.009e3)"


_EXPR = {
    "event_id": "event_id",
    "ts": "ts",
    "system_id": "concat('SYS-', lpad(CAST(user_id AS STRING), 9, '0'))",
    "fault_type": "CASE event_type WHEN 'view' THEN 'Normal' WHEN 'click' THEN 'Sensor Drift' "
                  "WHEN 'signup' THEN 'GPS Fault' WHEN 'purchase' THEN 'Battery Fault' ELSE 'Motor Overheating' END",
    "motor_temperature": "6e1 + least(value, 4.5e1)",
    "battery_level": f"CASE WHEN event_id % 97 = 0 THEN NULL ELSE 3e1 + 7e1 * {_u(7919)} END",
    "voltage": f"2e1 + 6e0 * {_u(104729)}",
    "current": f"8e0 + 1e1 * {_u(1299709)}",
    "vibration_x": _u(15485863),
    "vibration_y": _u(32452843),
    "vibration_z": _u(49979687),
    "acceleration_x": f"{_u(67867967)} - 5e-1",
    "acceleration_y": f"{_u(86028121)} - 5e-1",
    "acceleration_z": f"9e0 + {_u(104395301)}",
    "gps_accuracy": f"1e0 + 9e0 * {_u(122949823)}",
    "gps_satellite_count": "CAST(2 + (event_id * 31) % 13 AS DOUBLE)",
    "signal_strength": f"CASE WHEN event_id % 89 = 0 THEN NULL ELSE -1e2 + 7e1 * {_u(141650939)} END",
    "altitude": f"1e2 + 4e1 * {_u(160481183)}",
    "speed": f"5e0 + 2e1 * {_u(179424673)}",
    "heading": f"3.6e2 * {_u(198491317)}",
}
READINGS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _EXPR.items()) + " FROM events"

_RAW = [
    f"1e-1 + CAST(((event_id % 1009) * {7919 + 104729 * i}) % 1009 AS DOUBLE) / 1.009e3"
    f" + CASE WHEN fault_type = '{c}' THEN 6e-1 ELSE 0e0 END"
    for i, c in enumerate(CLASSES)
]
_TOTAL = " + ".join(f"r{i}" for i in range(len(CLASSES)))
SCORED_WIDE_SQL = (
    "SELECT row_id, label, " + ", ".join(f"round(r{i} / ({_TOTAL}), 6) AS p{i}" for i in range(len(CLASSES)))
    + " FROM (SELECT event_id AS row_id, fault_type AS label, "
    + ", ".join(f"{e} AS r{i}" for i, e in enumerate(_RAW)) + " FROM readings) raw"
)
SCORED_SQL = " UNION ALL ".join(
    f"SELECT row_id, label, '{c}' AS class, {i} AS idx, p{i} AS p FROM wide" for i, c in enumerate(CLASSES))

R = ("readings", READINGS_SQL)
S = (R, ("wide", SCORED_WIDE_SQL), ("scored", SCORED_SQL))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_readings(events: DataFrame) -> DataFrame:
    return events.selectExpr(*[f"{e} AS {n}" for n, e in _EXPR.items()])


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_readings(table(spark, sf_dir, "events"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, label, probs): class probabilities by position in `CLASSES`, the shape Spark ML emits."""
    raw = readings(spark, sf_dir).selectExpr(
        "event_id AS row_id", "fault_type AS label", *[f"{e} AS r{i}" for i, e in enumerate(_RAW)])
    probs = F.array(*[F.expr(f"round(r{i} / ({_TOTAL}), 6)") for i in range(len(CLASSES))])
    return raw.select("row_id", "label", probs.alias("probs"))


def drift_sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    early = F.expr(f"ts < {DRIFT_SPLIT}")
    return df.where(early), df.where(~early)


ALL_SENSORS = list(SENSORS)
