"""Counts, profiles, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.catalog.features import FUSED_CTES, fused
from fleetpulse.catalog.registry import query, r6, with_
from fleetpulse.catalog.views import CLASSES, READINGS, R, S, readings, scored, table
from fleetpulse.functions.lookups import RISK, recommendation, risk_level
from fleetpulse.functions.scalars import argmax, name_at, rounded
from fleetpulse.operators import explore as ex
from fleetpulse.operators.ordering import positions, quantiles
from fleetpulse.schema import DERIVED, PREVIEW_SENSORS, SENSORS

RISK_SQL = "CASE {0} " + " ".join(f"WHEN '{f}' THEN '{r}'" for f, r in RISK.items()) + " ELSE 'Unknown' END"
# first largest probability per row
TOP = ("top", "SELECT row_id, label, class AS predicted_fault, p AS confidence, label = class AS correct, "
       + RISK_SQL.format("class") + " AS risk_level FROM (SELECT *, row_number() OVER "
       "(PARTITION BY row_id ORDER BY p DESC, idx) AS rn FROM scored) t WHERE rn = 1")


def top_predictions(spark, sf_dir):
    """Argmax predictions of the score table, with confidence, risk and advice."""
    df = scored(spark, sf_dir)
    fault = name_at(CLASSES, argmax(F.col("probs")))
    return df.select("row_id", "label", fault.alias("predicted_fault"), F.array_max("probs").alias("confidence")
                     ).withColumns({"correct": F.col("label") == F.col("predicted_fault"),
                                    "risk_level": risk_level("predicted_fault"),
                                    "recommendation": recommendation("predicted_fault")})


@query("class_balance", with_(R, select="SELECT fault_type, count(*) AS count FROM readings GROUP BY 1"))
def class_balance(spark, sf_dir):
    return ex.counts_by(readings(spark, sf_dir), "fault_type")


_NULLS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END"
                    for c in ("event_id", "ts", "system_id", "fault_type", *SENSORS))


@query("dataset_summary", with_(R, select="SELECT count(*) AS rows, CAST(20 AS BIGINT) AS columns, "
                                f"CAST(sum({_NULLS}) AS BIGINT) AS missing_values FROM readings"))
def dataset_summary(spark, sf_dir):
    return ex.dataset_summary(readings(spark, sf_dir))


@query("dataset_preview", with_(R, select="SELECT * FROM readings ORDER BY system_id, ts, event_id LIMIT 15"))
def dataset_preview(spark, sf_dir):
    return ex.preview(readings(spark, sf_dir), ["system_id", "ts", "event_id"], 15)


@query("per_system_stats", with_(R, select="SELECT system_id, " + ", ".join(
    f"(round_even(avg({s}), 2) + 0e0) AS {s}_mean, (round_even(stddev_samp({s}), 2) + 0e0) AS {s}_std"
    for s in SENSORS) + " FROM readings GROUP BY 1"))
def per_system_stats(spark, sf_dir):
    return ex.per_system_stats(readings(spark, sf_dir), READINGS)


@query("system_fault_matrix", with_(R, select="SELECT system_id, " + ", ".join(
    f"CAST(sum(CASE WHEN fault_type = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{c}\"" for c in CLASSES)
    + " FROM readings GROUP BY 1"))
def system_fault_matrix(spark, sf_dir):
    return ex.system_fault_matrix(readings(spark, sf_dir), READINGS, CLASSES)


_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS count, " + ", ".join(
        f"(round_even({e}, 3) + 0e0) AS {n}" for n, e in {
            "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})",
            "p25": f"quantile_cont({c}, 0.25)", "p50": f"quantile_cont({c}, 0.5)",
            "p75": f"quantile_cont({c}, 0.75)", "max": f"max({c})"}.items()) + " FROM fused" for c in DERIVED)


@query("describe_features", with_(*FUSED_CTES, select=_DESCRIBE))
def describe_features(spark, sf_dir):
    return ex.describe_features(fused(spark, sf_dir), list(DERIVED))


def _box(source: str, key: str) -> tuple:
    stats = (f"SELECT {key} AS k, " + ", ".join(
        f"quantile_cont(value, {p}) AS {n}" for p, n in
        ((0.0, "mn"), (0.25, "q1"), (0.5, "md"), (0.75, "q3"), (1.0, "mx")))
        + f" FROM {source} WHERE value IS NOT NULL GROUP BY 1")
    lo, hi = "q1 - (q3 - q1) * 1.5e0", "q3 + (q3 - q1) * 1.5e0"
    select = (f"SELECT {key}, count(*) AS count, " + ", ".join([
        r6("min(mn)", "min"), r6("min(q1)", "q1"), r6("min(md)", "median"), r6("min(q3)", "q3"), r6("min(mx)", "max"),
        r6(f"min(CASE WHEN value BETWEEN {lo} AND {hi} THEN value END)", "whisker_low"),
        r6(f"max(CASE WHEN value BETWEEN {lo} AND {hi} THEN value END)", "whisker_high")])
        + f", CAST(sum(CASE WHEN value BETWEEN {lo} AND {hi} THEN 0 ELSE 1 END) AS BIGINT) AS outliers"
        f" FROM {source} JOIN stats ON {key} = k WHERE value IS NOT NULL GROUP BY 1")
    return ("stats", stats), select


def _melt(cols, src="readings", name="sensor"):
    return " UNION ALL ".join(f"SELECT '{c}' AS {name}, {c} AS value FROM {src}" for c in cols)


_st, _sel = _box("melted", "sensor")


@query("sensor_distribution", with_(R, ("melted", _melt(PREVIEW_SENSORS)), _st, select=_sel))
def sensor_distribution(spark, sf_dir):
    return rounded(ex.sensor_distribution(readings(spark, sf_dir), PREVIEW_SENSORS))


_st, _sel = _box("melted", "fault_type")


@query("feature_by_class", with_(*FUSED_CTES, ("melted", "SELECT fault_type, power_fluctuation_score AS value FROM fused"),
                                 _st, select=_sel))
def feature_by_class(spark, sf_dir):
    return rounded(ex.feature_by_class(fused(spark, sf_dir), READINGS, "power_fluctuation_score"))


@query("histogram", with_(R, ("span", "SELECT min(motor_temperature) AS lo, "
                              "(max(motor_temperature) - min(motor_temperature)) / 40 AS width FROM readings"),
                          ("filled", "SELECT CAST(least(floor((motor_temperature - lo) / width), 39) AS INTEGER) AS bin, "
                           "count(*) AS n FROM readings CROSS JOIN span GROUP BY 1"),
                          select="SELECT b.bin, " + r6("lo + b.bin * width", "lower") + ", "
                          + r6("lo + (b.bin + 1) * width", "upper") + ", coalesce(n, 0) AS count FROM "
                          "(SELECT CAST(range AS INTEGER) AS bin FROM range(40)) b CROSS JOIN span "
                          "LEFT JOIN filled ON b.bin = filled.bin"))
def histogram(spark, sf_dir):
    return rounded(ex.histogram(readings(spark, sf_dir), "motor_temperature", 40))


@query("distinct_counts", with_(R, select="SELECT count(DISTINCT system_id) AS systems, "
                                "count(DISTINCT fault_type) AS classes FROM readings"))
def distinct_counts(spark, sf_dir):
    return ex.distinct_counts(readings(spark, sf_dir), READINGS)


@query("distinct_systems", with_(R, select="SELECT DISTINCT system_id FROM readings ORDER BY 1"))
def distinct_systems(spark, sf_dir):
    return ex.distinct_systems(readings(spark, sf_dir), READINGS)


@query("prediction_summary", with_(*S, TOP, select="SELECT 'fault' AS kind, predicted_fault AS name, count(*) AS count, "
       "CAST(NULL AS DOUBLE) AS mean_confidence FROM top GROUP BY 2 UNION ALL SELECT 'risk', risk_level, count(*), NULL "
       "FROM top GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*), round(avg(confidence), 6) FROM top"))
def prediction_summary(spark, sf_dir):
    return rounded(ex.prediction_summary(top_predictions(spark, sf_dir)))


@query("alarm_counts_by_risk", with_(*S, TOP, select="SELECT risk_level, count(*) AS count FROM top "
                                     "WHERE risk_level IN ('High', 'Critical') GROUP BY 1"))
def alarm_counts_by_risk(spark, sf_dir):
    alarms = top_predictions(spark, sf_dir).where(F.col("risk_level").isin("High", "Critical"))
    return ex.counts_by(alarms, "risk_level")


CUT = ("cut", "SELECT quantile_cont(p, 0.08) AS threshold FROM scored WHERE class = 'Normal'")
FLAGGED = ("flagged", "SELECT row_id, label, p AS score, p < threshold AS is_anomaly FROM scored CROSS JOIN cut "
           "WHERE class = 'Normal'")


def flagged(spark, sf_dir):
    from fleetpulse.operators.isolation import flag_anomalies

    df = scored(spark, sf_dir).select("row_id", "label", F.col("probs")[CLASSES.index("Normal")].alias("score"))
    return flag_anomalies(df, "score", 0.08)


@query("flag_anomalies", with_(*S, CUT, FLAGGED, select="SELECT row_id, score, is_anomaly FROM flagged"))
def flag_anomalies_query(spark, sf_dir):
    return flagged(spark, sf_dir).select("row_id", "score", "is_anomaly")


@query("anomaly_breakdown", with_(*S, CUT, FLAGGED, select="SELECT label, count(*) AS samples, "
       "CAST(sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS BIGINT) AS anomalies, "
       + r6("avg(CASE WHEN is_anomaly THEN 1e0 ELSE 0e0 END)", "anomaly_rate") + " FROM flagged GROUP BY 1"))
def anomaly_breakdown(spark, sf_dir):
    return rounded(ex.anomaly_breakdown(flagged(spark, sf_dir), "label", "is_anomaly"))


@query("prediction_accuracy", with_(*S, TOP, select="SELECT count(*) AS total, "
       "CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM top"))
def prediction_accuracy(spark, sf_dir):
    return ex.prediction_accuracy(top_predictions(spark, sf_dir))


_DESC = "PARTITION BY system_id ORDER BY ts DESC, event_id DESC"


@query("rul_label", with_(R, select=f"SELECT event_id, system_id, row_number() OVER ({_DESC}) - 1 AS rul FROM readings"))
def rul_label(spark, sf_dir):
    return ex.rul_label(readings(spark, sf_dir), READINGS).select("event_id", "system_id", "rul")


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE_ORDER = ["l_shipdate", *[c for c in LINE if c not in ("l_shipdate", "l_suppkey")]]
CYCLES = ("cycles", "SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY "
          + ", ".join(_LINE_ORDER) + ") AS cycle FROM lineitem")


def cycles(spark, sf_dir):
    """Lines of a supplier in shipping order, as cycles of a unit."""
    placed = positions(table(spark, sf_dir, "lineitem"), "l_suppkey", _LINE_ORDER, "cycle", "n")
    return placed.withColumn("cycle", F.col("cycle") + 1).drop("n")


@query("rul_cycle_label", with_(CYCLES, select="SELECT *, CASE WHEN rul <= 50 THEN 'Motor Overheating' ELSE 'Normal' END "
       "AS fault_type FROM (SELECT *, max(cycle) OVER (PARTITION BY l_suppkey) - cycle AS rul FROM cycles) t"))
def rul_cycle_label(spark, sf_dir):
    return ex.rul_cycle_label(cycles(spark, sf_dir), "l_suppkey", "cycle")


RUNS = (
    ("changes", "SELECT *, CASE WHEN lag(fault_type) OVER w IS DISTINCT FROM fault_type THEN 1 ELSE 0 END AS c "
     "FROM readings WINDOW w AS (PARTITION BY system_id ORDER BY ts, event_id)"),
    ("islands", "SELECT *, sum(c) OVER (PARTITION BY system_id ORDER BY ts, event_id) AS island FROM changes"),
    ("runs", "SELECT system_id, fault_type, island, min(ts) AS start_ts, max(ts) AS end_ts, min(event_id) AS tie "
     "FROM islands WHERE fault_type <> 'Normal' GROUP BY 1, 2, 3"),
)


@query("fault_windows", with_(R, *RUNS, select="SELECT system_id, start_ts, end_ts, fault_type FROM (SELECT *, "
       "row_number() OVER (PARTITION BY system_id ORDER BY end_ts - start_ts DESC, start_ts, tie) AS rn FROM runs) t "
       "WHERE rn <= 80"))
def fault_windows(spark, sf_dir):
    return ex.fault_windows(readings(spark, sf_dir), READINGS)


@query("downsample_trace", with_(R, select="SELECT system_id, ts, event_id, speed FROM (SELECT *, "
       "row_number() OVER (PARTITION BY system_id ORDER BY ts, event_id) - 1 AS i, "
       "count(*) OVER (PARTITION BY system_id) AS n FROM readings) t WHERE i % greatest(1, n // 25) = 0"))
def downsample_trace(spark, sf_dir):
    return ex.downsample_trace(readings(spark, sf_dir), READINGS, "speed", max_points=25)


@query("system_series", with_(R, select="SELECT system_id, ts, event_id, motor_temperature FROM readings ORDER BY 1, 2, 3"))
def system_series(spark, sf_dir):
    return ex.system_series(readings(spark, sf_dir), READINGS, "motor_temperature")


@query("edges_distinct", with_(R, select="SELECT DISTINCT 'gps_satellite_count' AS feature, unnest(quantile_cont("
       "gps_satellite_count, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS edge FROM readings"))
def edges_distinct(spark, sf_dir):
    df = readings(spark, sf_dir).select(F.lit("gps_satellite_count").alias("feature"), "gps_satellite_count")
    q = quantiles(df, "feature", "gps_satellite_count", [i / 10 for i in range(11)])
    return q.select("feature", F.explode(F.array_distinct("q")).alias("edge"))
