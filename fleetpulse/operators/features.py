"""Per-system time-series features and cross-sensor indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import at_least, at_most, magnitude
from fleetpulse.operators.ordering import with_neighbours
from fleetpulse.schema import ROLLING_SENSORS, ReadingSchema

STABILITY_ROWS = 5


def vector_magnitude(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "vibration_magnitude": magnitude("vibration_x", "vibration_y", "vibration_z"),
        "acceleration_magnitude": magnitude("acceleration_x", "acceleration_y", "acceleration_z"),
    })


def _step(name: str, w: WindowSpec) -> Column:
    return F.col(name) - F.lag(name).over(w)


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def rate_columns(w: WindowSpec) -> dict[str, Column]:
    """Change since the previous reading; 0.0 wherever either side is missing."""
    fall = lambda name: F.lag(name).over(w) - F.col(name)
    return {
        "battery_drop_rate": _or_zero(fall("battery_level")),
        "temperature_rise_rate": _or_zero(_step("motor_temperature", w)),
        "signal_drop_rate": _or_zero(fall("signal_strength")),
        "speed_change_rate": _or_zero(F.abs(_step("speed", w))),
        "altitude_change_rate": _or_zero(F.abs(_step("altitude", w))),
    }


def stability_columns(w: WindowSpec) -> dict[str, Column]:
    recent = w.rowsBetween(1 - STABILITY_ROWS, 0)
    spread = lambda name: _or_zero(F.stddev_samp(name).over(recent))
    return {
        "gps_stability_score": 1.0 / (1.0 + spread("gps_accuracy")),
        "power_fluctuation_score": spread("voltage") + spread("current"),
    }


def rolling_exprs(w: WindowSpec, window: int, sensors: Sequence[str]) -> dict[str, Column]:
    frame = w.rowsBetween(1 - window, 0)
    out: dict[str, Column] = {}
    for s in sensors:
        x = F.col(s)
        out[f"{s}_mean_w{window}"] = F.avg(x).over(frame)
        out[f"{s}_std_w{window}"] = _or_zero(F.stddev_samp(x).over(frame))
        out[f"{s}_range_w{window}"] = _or_zero(F.max(x).over(frame) - F.min(x).over(frame))
        out[f"{s}_energy_w{window}"] = F.sum(x * x).over(frame)
    return out


def rate_of_change(df: DataFrame, schema: ReadingSchema, layout: str = "auto", **sizes) -> DataFrame:
    return with_neighbours(df, schema.system, [schema.ts, schema.tie],
                           lambda d, w: d.withColumns(rate_columns(w)), back=1, layout=layout, **sizes)


def rolling_stability(df: DataFrame, schema: ReadingSchema, layout: str = "auto", **sizes) -> DataFrame:
    return with_neighbours(df, schema.system, [schema.ts, schema.tie],
                           lambda d, w: d.withColumns(stability_columns(w)),
                           back=STABILITY_ROWS - 1, layout=layout, **sizes)


def rolling_features(
    df: DataFrame, schema: ReadingSchema, window: int = 10, sensors: Sequence[str] | None = None,
    layout: str = "auto", **sizes,
) -> DataFrame:
    """Mean, deviation, range and energy of the last `window` readings of each available sensor."""
    chosen = [s for s in (sensors or ROLLING_SENSORS) if s in df.columns]
    return with_neighbours(df, schema.system, [schema.ts, schema.tie],
                           lambda d, w: d.withColumns(rolling_exprs(w, window, chosen)),
                           back=window - 1, layout=layout, **sizes)


def navigation_stats(df: DataFrame) -> DataFrame:
    """One row: the table-wide speed and altitude statistics behind the navigation score."""
    return df.agg(F.struct(
        F.avg("speed").alias("speed_mean"), F.stddev_samp("speed").alias("speed_std"),
        F.avg("altitude").alias("altitude_mean"), F.stddev_samp("altitude").alias("altitude_std"),
    ).alias("stats"))


def fit_navigation(df: DataFrame) -> dict[str, float]:
    """Fitted statistics, to be kept with a model and reused when serving."""
    return navigation_stats(df).first()["stats"].asDict()


def navigation_consistency(df: DataFrame, fitted: dict[str, float] | None = None,
                           stats_from: DataFrame | None = None) -> DataFrame:
    """Add the navigation score, from fitted statistics or from those of the batch itself.

    The batch statistics enter as a scalar subquery: partial aggregates, no join and no global window.
    """
    if fitted:
        stat = lambda n: F.lit(fitted[n])
    else:
        df = df.withColumn("__nav", navigation_stats(df if stats_from is None else stats_from).scalar())
        stat = lambda n: F.col("__nav")[n]
    z = lambda n: F.abs((F.col(n) - stat(f"{n}_mean")) / (stat(f"{n}_std") + 1e-6))
    return df.withColumn("navigation_consistency_score", 1.0 / (1.0 + z("speed") + z("altitude"))).drop("__nav")


def fusion_indices(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "thermal_power_index":
            at_least(F.col("motor_temperature") - 70.0, 0.0) / 30.0 + F.abs("current") / 20.0,
        "mechanical_stress_index":
            F.col("vibration_magnitude") + F.abs("acceleration_magnitude") / 10.0,
        "comm_nav_health_index":
            at_most(F.col("signal_strength"), -40.0) / -100.0
            + F.col("gps_satellite_count") / 15.0 + F.col("gps_stability_score"),
    })
