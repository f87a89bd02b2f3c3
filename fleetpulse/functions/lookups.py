"""Fault → risk and fault → advice tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Risk level and advice text per fault class.
RISK = {
    "Normal": "Low",
    "Sensor Drift": "Medium",
    "GPS Fault": "Medium-High",
    "Communication Fault": "Medium-High",
    "Navigation Instability": "High",
    "Vibration Fault": "High",
    "Power Instability": "High",
    "Battery Fault": "High",
    "Motor Overheating": "Critical",
}
ADVICE = {
    "Normal": "System is within normal range. Continue routine monitoring.",
    "Battery Fault": "Inspect battery cells; review charge cycles and voltage profile.",
    "Motor Overheating": "Stop the motor and check the cooling system and load profile.",
    "GPS Fault": "Check the GPS antenna and sky view; switch to backup positioning if needed.",
    "Communication Fault": "Check link range, antenna alignment and telemetry status.",
    "Sensor Drift": "Recalibrate the affected sensor and cross-check against a redundant sensor.",
    "Vibration Fault": "Inspect mechanical mounts, propeller balance and fastener torque.",
    "Power Instability": "Check the power regulator and wiring; monitor current draw.",
    "Navigation Instability": "Verify the IMU/GPS fusion and review the control loop tuning.",
}
ALARM_RISKS = ("High", "Critical")


def _choose(fault: str | Column, table: dict[str, str], default: str) -> Column:
    fault = F.col(fault) if isinstance(fault, str) else fault
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), fault), F.lit(default))


def risk_level(fault: str | Column) -> Column:
    return _choose(fault, RISK, "Unknown")


def recommendation(fault: str | Column) -> Column:
    return _choose(fault, ADVICE, "")


def lookup_table(spark: SparkSession) -> DataFrame:
    """The nine-row table behind the expressions, for joins."""
    rows = [(f, RISK[f], ADVICE[f]) for f in RISK]
    return spark.createDataFrame(rows, "fault string, risk_level string, recommendation string")


def join_lookup(df: DataFrame, fault: str) -> DataFrame:
    """Left join on the lookup table: nine fixed rows, hence always a broadcast."""
    table = F.broadcast(lookup_table(df.sparkSession).withColumnRenamed("fault", "_fault"))
    return (
        df.join(table, df[fault] == table["_fault"], "left").drop("_fault")
        .withColumn("risk_level", F.coalesce("risk_level", F.lit("Unknown")))
        .withColumn("recommendation", F.coalesce("recommendation", F.lit("")))
    )
