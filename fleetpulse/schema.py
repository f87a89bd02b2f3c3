"""Column names of a readings table and the fixed names derived from it."""

from __future__ import annotations

from dataclasses import dataclass, field

# Sensor, feature and class names that results must carry.
SENSORS = (
    "motor_temperature", "battery_level", "voltage", "current",
    "vibration_x", "vibration_y", "vibration_z",
    "acceleration_x", "acceleration_y", "acceleration_z",
    "gps_accuracy", "gps_satellite_count", "signal_strength",
    "altitude", "speed", "heading",
)
DERIVED = (
    "battery_drop_rate", "temperature_rise_rate", "vibration_magnitude", "signal_drop_rate",
    "gps_stability_score", "power_fluctuation_score", "navigation_consistency_score",
    "acceleration_magnitude", "speed_change_rate", "altitude_change_rate",
)
ROLLING_SENSORS = (
    "motor_temperature", "battery_level", "voltage", "current",
    "vibration_magnitude", "gps_accuracy", "signal_strength", "speed",
)
ROLLING_STATS = ("mean", "std", "range", "energy")
FUSION = ("thermal_power_index", "mechanical_stress_index", "comm_nav_health_index")
PREVIEW_SENSORS = (
    "motor_temperature", "battery_level", "voltage", "current",
    "vibration_x", "gps_accuracy", "signal_strength", "speed",
)


@dataclass(frozen=True)
class ReadingSchema:
    """Where to find the parts of a reading.

    `tie` must make `(system, ts, tie)` unique: every ordered operator uses it to
    give rows with equal timestamps one fixed order.
    """

    system: str = "system_id"
    ts: str = "timestamp"
    tie: str = "row_id"
    label: str = "fault_type"
    sensors: tuple[str, ...] = field(default=SENSORS)

    @property
    def meta(self) -> tuple[str, ...]:
        return (self.ts, self.system, self.label)

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.tie, *self.meta)


def rolling_columns(window: int = 10, sensors=ROLLING_SENSORS) -> list[str]:
    return [f"{s}_{stat}_w{window}" for s in sensors for stat in ROLLING_STATS]


def missing_columns(df, schema: ReadingSchema = ReadingSchema()) -> list[str]:
    """Required columns (sensors and time) that `df` lacks, sorted."""
    return sorted({*schema.sensors, schema.ts} - set(df.columns))


def meta_first(df, schema: ReadingSchema = ReadingSchema()):
    """Same columns, metadata before measurements."""
    head = [c for c in schema.meta if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def numeric_features(df, schema: ReadingSchema = ReadingSchema(), drop=()) -> list[str]:
    """Numeric columns that may feed a model, in table order."""
    from pyspark.sql.types import NumericType

    skip = {*schema.keys, *drop}
    names = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skip]
    if not names:
        raise ValueError("no numeric feature columns left after dropping metadata")
    return names
