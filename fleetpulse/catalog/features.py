"""Projections, windows and the full feature frame."""

from __future__ import annotations

from fleetpulse.catalog.registry import query, r6, with_
from fleetpulse.catalog.views import READINGS, R, readings
from fleetpulse.functions.scalars import rounded
from fleetpulse.operators import features as ft
from fleetpulse.plans.fused import fused_frame
from fleetpulse.schema import DERIVED, FUSION, ROLLING_SENSORS, ROLLING_STATS, SENSORS, rolling_columns

KEYS = ["event_id", "system_id"]
VIB = "sqrt(vibration_x * vibration_x + vibration_y * vibration_y + vibration_z * vibration_z)"
ACC = "sqrt(acceleration_x * acceleration_x + acceleration_y * acceleration_y + acceleration_z * acceleration_z)"
NAV_STATS = ("nav", "SELECT avg(speed) AS sm, stddev_samp(speed) AS ss, avg(altitude) AS am, "
                    "stddev_samp(altitude) AS sa FROM readings")
NAV = "1e0 / (1e0 + abs((speed - sm) / (ss + 1e-6)) + abs((altitude - am) / (sa + 1e-6)))"
STD5 = "coalesce(stddev_samp({0}) OVER w5, 0e0)"
RATES = {
    "battery_drop_rate": "coalesce(lag(battery_level) OVER w - battery_level, 0e0)",
    "temperature_rise_rate": "coalesce(motor_temperature - lag(motor_temperature) OVER w, 0e0)",
    "signal_drop_rate": "coalesce(lag(signal_strength) OVER w - signal_strength, 0e0)",
    "speed_change_rate": "coalesce(abs(speed - lag(speed) OVER w), 0e0)",
    "altitude_change_rate": "coalesce(abs(altitude - lag(altitude) OVER w), 0e0)",
}
STABILITY = {
    "gps_stability_score": f"1e0 / (1e0 + {STD5.format('gps_accuracy')})",
    "power_fluctuation_score": f"{STD5.format('voltage')} + {STD5.format('current')}",
}
ROLL = {
    "mean": "avg({0}) OVER w10",
    "std": "coalesce(stddev_samp({0}) OVER w10, 0e0)",
    "range": "coalesce(max({0}) OVER w10 - min({0}) OVER w10, 0e0)",
    "energy": "sum({0} * {0}) OVER w10",
}
ROLLING = {f"{s}_{stat}_w10": ROLL[stat].format(s) for s in ROLLING_SENSORS for stat in ROLLING_STATS}
_W = "PARTITION BY system_id ORDER BY ts, event_id"
WINDOWS = (f"WINDOW w AS ({_W}), w5 AS ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), "
           f"w10 AS ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
FUSION_SQL = {
    "thermal_power_index": "CASE WHEN motor_temperature - 7e1 < 0e0 THEN 0e0 ELSE motor_temperature - 7e1 END / 3e1"
                           " + abs(current) / 2e1",
    "mechanical_stress_index": "vibration_magnitude + abs(acceleration_magnitude) / 1e1",
    "comm_nav_health_index": "CASE WHEN signal_strength > -4e1 THEN -4e1 ELSE signal_strength END / -1e2"
                             " + gps_satellite_count / 1.5e1 + gps_stability_score",
}
MAG = ("mag", f"SELECT *, {VIB} AS vibration_magnitude, {ACC} AS acceleration_magnitude FROM readings")
ORDERED = ("ordered", "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in {**RATES, **STABILITY, **ROLLING}.items())
           + f" FROM mag {WINDOWS}")
FUSED = ("fused", f"SELECT ordered.*, {NAV} AS navigation_consistency_score, "
         + ", ".join(f"{e} AS {n}" for n, e in FUSION_SQL.items()) + " FROM ordered CROSS JOIN nav")
FUSED_CTES = (R, MAG, NAV_STATS, ORDERED, FUSED)
FUSED_FEATURES = [*SENSORS, *DERIVED, *rolling_columns(10), *FUSION]


def fused(spark, sf_dir):
    return fused_frame(readings(spark, sf_dir), READINGS)


def _cols(names):
    return ", ".join(r6(n, n) for n in names)


@query("vector_magnitude", with_(R, MAG, select=f"SELECT event_id, system_id, "
                                 f"{_cols(['vibration_magnitude', 'acceleration_magnitude'])} FROM mag"))
def vector_magnitude(spark, sf_dir):
    out = ft.vector_magnitude(readings(spark, sf_dir))
    return rounded(out.select(*KEYS, "vibration_magnitude", "acceleration_magnitude"))


def _ordered_sql(cols):
    return with_(R, MAG, select="SELECT event_id, system_id, " + ", ".join(r6(e, n) for n, e in cols.items())
                 + f" FROM mag {WINDOWS}")


@query("rate_of_change", _ordered_sql(RATES))
def rate_of_change(spark, sf_dir):
    return rounded(ft.rate_of_change(readings(spark, sf_dir), READINGS).select(*KEYS, *RATES))


@query("rolling_stability", _ordered_sql(STABILITY))
def rolling_stability(spark, sf_dir):
    return rounded(ft.rolling_stability(readings(spark, sf_dir), READINGS).select(*KEYS, *STABILITY))


@query("rolling_features", _ordered_sql(ROLLING))
def rolling_features(spark, sf_dir):
    df = ft.vector_magnitude(readings(spark, sf_dir))
    return rounded(ft.rolling_features(df, READINGS).select(*KEYS, *ROLLING))


@query("navigation_consistency", with_(R, NAV_STATS, select="SELECT event_id, system_id, "
                                       f"{r6(NAV, 'navigation_consistency_score')} FROM readings CROSS JOIN nav"))
def navigation_consistency(spark, sf_dir):
    out = ft.navigation_consistency(readings(spark, sf_dir))
    return rounded(out.select(*KEYS, "navigation_consistency_score"))


@query("join_stats", with_(R, NAV_STATS, select="SELECT event_id, " + r6("speed - sm", "speed_centred") + ", "
                           + r6("altitude - am", "altitude_centred") + " FROM readings CROSS JOIN nav"))
def join_stats(spark, sf_dir):
    df = readings(spark, sf_dir)
    stats = ft.navigation_stats(df).scalar()
    return rounded(df.select("event_id", (df.speed - stats["speed_mean"]).alias("speed_centred"),
                             (df.altitude - stats["altitude_mean"]).alias("altitude_centred")))


@query("fusion_indices", with_(*FUSED_CTES, select=f"SELECT event_id, system_id, {_cols(FUSION)} FROM fused"))
def fusion_indices(spark, sf_dir):
    df = ft.rolling_stability(ft.vector_magnitude(readings(spark, sf_dir)), READINGS)
    return rounded(ft.fusion_indices(df).select(*KEYS, *FUSION))


@query("fused_frame", with_(*FUSED_CTES, select="SELECT event_id, ts, system_id, fault_type, "
                            f"{_cols(FUSED_FEATURES)} FROM fused"))
def fused_frame_query(spark, sf_dir):
    return rounded(fused(spark, sf_dir).select("event_id", "ts", "system_id", "fault_type", *FUSED_FEATURES))
