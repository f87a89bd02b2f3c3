"""Streaming jobs over the events file, read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.catalog.drift import PSI, KS, MEANS, _REPORT_COLS, LEVEL
from fleetpulse.catalog.explore import RISK_SQL
from fleetpulse.catalog.features import ROLL, WINDOWS
from fleetpulse.catalog.prepare import ADVICE_SQL
from fleetpulse.catalog.ranking import D, FEATURES, INTERCEPTS, K, WEIGHTS, _argname, _pmax, _softmax
from fleetpulse.catalog.registry import query, r6, with_
from fleetpulse.catalog.views import CLASSES, READINGS, R, as_readings, drift_sides, readings
from fleetpulse.functions.lookups import lookup_table
from fleetpulse.functions.scalars import rounded
from fleetpulse.operators.features import vector_magnitude
from fleetpulse.operators.linear import LinearModel
from fleetpulse.schema import ROLLING_SENSORS, SENSORS
from fleetpulse.streaming import jobs

# scales fitted elsewhere and fixed here: a stream has no whole-table statistics; missing readings count as 0
SCALE = [60.0, 100.0, 25.0, 18.0, 1.0, 10.0, 100.0, 25.0]
LIVE = LinearModel(tuple(CLASSES), tuple(f"z{j}" for j in D), tuple(map(tuple, WEIGHTS)), tuple(INTERCEPTS))


def live_score(df):
    z = {f"z{j}": F.coalesce(F.col(f) / SCALE[j], F.lit(0.0)) for j, f in enumerate(FEATURES)}
    return LIVE.probabilities(df.withColumns(z))


_m = lambda c: f"{INTERCEPTS[c]!r}e0 + " + " + ".join(
    f"({WEIGHTS[c][j]!r}e0) * coalesce({f} / {SCALE[j]!r}e0, 0e0)" for j, f in enumerate(FEATURES))
LIVE_SQL = (R, ("zm", "SELECT *, " + ", ".join(f"{_m(c)} AS m{c}" for c in K) + " FROM readings"), ("lin", _softmax.format(src="zm")),
            ("live", f"SELECT *, {_argname} AS predicted_fault, {_pmax} AS confidence FROM lin"),
            ("risky", f"SELECT *, {RISK_SQL.format('predicted_fault')} AS risk_level FROM live"))


def source(spark, sf_dir):
    return as_readings(jobs.file_stream(spark, f"{sf_dir}/events.parquet"))


@query("stream_score", with_(*LIVE_SQL, select="SELECT event_id, ts AS t, system_id, fault_type AS actual_fault, predicted_fault, "
       + r6("confidence", "confidence") + ", risk_level, " + ", ".join(r6(s, s) for s in jobs.LIVE_SENSORS) + " FROM risky"))
def stream_score(spark, sf_dir):
    out = jobs.run_to_table(jobs.score_stream(source(spark, sf_dir), live_score, CLASSES, READINGS), "scores")
    return rounded(out.select(*[c for c in out.columns if c != "sensors"], "sensors.*"))


ALARMS = "SELECT event_id, ts AS timestamp, system_id, predicted_fault AS fault, risk_level AS risk, " + r6("confidence", "confidence") + \
    f", {ADVICE_SQL.format('predicted_fault')} AS recommendation, 'live' AS source FROM risky WHERE risk_level IN ('High', 'Critical')"


def alarm_table(spark, sf_dir):
    return jobs.run_to_table(jobs.alarm_stream(source(spark, sf_dir), live_score, CLASSES, READINGS), "alarms")


@query("stream_alarms", with_(*LIVE_SQL, select=ALARMS))
def stream_alarms(spark, sf_dir):
    return rounded(alarm_table(spark, sf_dir).drop("payload"))


@query("stream_latest_alarms", with_(*LIVE_SQL, select=ALARMS + " ORDER BY ts DESC, event_id DESC LIMIT 200"))
def stream_latest_alarms(spark, sf_dir):
    from fleetpulse.plans.scoring import latest_alarms

    return rounded(latest_alarms(alarm_table(spark, sf_dir), "event_id").drop("payload"))


@query("stream_recent_readings", with_(R, select="SELECT system_id, ts, event_id, speed FROM (SELECT *, row_number() OVER "
       "(PARTITION BY system_id ORDER BY ts DESC, event_id DESC) AS rn FROM readings) t WHERE rn <= 120"))
def stream_recent_readings(spark, sf_dir):
    stream = source(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.run_to_table(jobs.recent_stream(stream, READINGS, ["speed"], jobs.LIVE_ROWS), "recent", "update")
    # the newest emission of a system replaces the older ones
    last = out.groupBy("system_id").agg(F.max("batch").alias("batch"))
    return out.join(last, ["system_id", "batch"]).drop("batch").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


ROLLED = [f"{s}_{stat}_w10" for s in ROLLING_SENSORS for stat in ROLL]


@query("stream_rolling_features", with_(R, ("mag", "SELECT *, sqrt(vibration_x * vibration_x + vibration_y * vibration_y + vibration_z * vibration_z) "
       "AS vibration_magnitude FROM readings"), select="SELECT event_id, system_id, " + ", ".join(
    r6(ROLL[stat].format(s), f"{s}_{stat}_w10") for s in ROLLING_SENSORS for stat in ROLL) + f" FROM mag {WINDOWS}"))
def stream_rolling_features(spark, sf_dir):
    stream = source(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rolled = jobs.rolling_stream(vector_magnitude(stream), READINGS, 10)
    return rounded(jobs.run_to_table(rolled, "rolling").select("event_id", "system_id", *ROLLED))


@query("stream_fault_rate", with_(R, select="SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY "
       "AS window_end, fault_type, count(*) AS count FROM readings GROUP BY 1, 2, 3"))
def stream_fault_rate(spark, sf_dir):
    out = jobs.run_to_table(jobs.fault_rate_stream(source(spark, sf_dir), READINGS), "rates", "update")
    return jobs.newest(out, ["window_start", "window_end", "fault_type"]).withColumns({
        c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("stream_fault_sessions", with_(R, ("f", "SELECT *, lag(ts) OVER (PARTITION BY system_id, fault_type ORDER BY ts, event_id) AS prev "
       "FROM readings WHERE fault_type <> 'Normal'"), ("g", "SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 1 DAY THEN 1 "
       "ELSE 0 END) OVER (PARTITION BY system_id, fault_type ORDER BY ts, event_id) AS s FROM f"),
       select="SELECT system_id, fault_type, min(ts) AS start_ts, max(ts) + INTERVAL 1 DAY AS end_ts, count(*) AS count "
       "FROM g GROUP BY system_id, fault_type, s"))
def stream_fault_sessions(spark, sf_dir):
    """Complete mode, so that sessions the watermark has not closed yet are in the result too."""
    out = jobs.run_to_table(jobs.fault_session_stream(source(spark, sf_dir), READINGS), "sessions", "complete")
    last = out.agg(F.max("batch").alias("b")).scalar()
    return out.where(F.col("batch") == last).drop("batch").withColumns({
        c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")})


_WHOLE = ("long", f"SELECT feature, value, is_ref FROM (SELECT true AS is_ref, {', '.join(SENSORS)} FROM readings WHERE ts < TIMESTAMP "
          f"'2024-01-16 00:00:00' UNION ALL SELECT false, {', '.join(SENSORS)} FROM readings) UNPIVOT (value FOR feature IN ({', '.join(SENSORS)}))")


@query("stream_drift", with_(R, _WHOLE, *PSI, *KS, MEANS, select="SELECT " + _REPORT_COLS + f" FROM (SELECT psi.feature, psi, {LEVEL}, "
       "ks_statistic, ks_pvalue, reference_mean, current_mean, current_mean - reference_mean AS mean_shift FROM psi "
       "JOIN pvals ON psi.feature = pvals.feature JOIN means ON psi.feature = means.feature) q"))
def stream_drift(spark, sf_dir):
    """Every arriving reading against the early half; the whole file arrives as one batch."""
    reference = drift_sides(readings(spark, sf_dir))[0]
    out = jobs.drift_stream(source(spark, sf_dir), reference, READINGS, list(SENSORS), "drift")
    last = out.agg(F.max("batch").alias("b")).scalar()
    return rounded(out.where(F.col("batch") == last).drop("batch"))


@query("stream_static_join", with_(R, select=f"SELECT event_id, fault_type, {RISK_SQL.format('fault_type')} AS risk_level FROM readings"))
def stream_static_join(spark, sf_dir):
    static = lookup_table(spark).select(F.col("fault").alias("fault_type"), "risk_level")
    joined = jobs.join_static(source(spark, sf_dir).select("event_id", "fault_type"), static, "fault_type")
    return jobs.run_to_table(joined, "joined").select("event_id", "fault_type", "risk_level")
