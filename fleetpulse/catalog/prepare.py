"""Preparing, mixing, looking up."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.catalog.explore import RISK_SQL
from fleetpulse.catalog.registry import query, r6, with_
from fleetpulse.catalog.views import READINGS, R, readings
from fleetpulse.functions.lookups import ADVICE, join_lookup, recommendation, risk_level
from fleetpulse.functions.scalars import rounded
from fleetpulse.operators import prepare as pr
from fleetpulse.schema import SENSORS
from fleetpulse.sources import mixes

ADVICE_SQL = "CASE {0} " + " ".join(f"WHEN '{f}' THEN '{a}'" for f, a in ADVICE.items()) + " ELSE '' END"
# readings without a battery level count as unlabelled: the table has no missing label of its own
PART = ("part_labelled", "SELECT * REPLACE (CASE WHEN battery_level IS NULL THEN NULL ELSE fault_type END AS fault_type) "
        "FROM readings")
GAPPY = ["battery_level", "signal_strength"]


@query("drop_unlabelled", with_(R, PART, select="SELECT event_id, fault_type FROM part_labelled WHERE fault_type IS NOT NULL"))
def drop_unlabelled(spark, sf_dir):
    label = F.when(F.col("battery_level").isNotNull(), F.col("fault_type"))
    return pr.drop_unlabelled(readings(spark, sf_dir).withColumn("fault_type", label), READINGS).select("event_id", "fault_type")


_W = "PARTITION BY system_id ORDER BY ts, event_id"
FILL = {c: f"coalesce({c}, last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
           f"first_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))" for c in GAPPY}


@query("fill_gaps", with_(R, select="SELECT event_id, system_id, " + ", ".join(r6(e, c) for c, e in FILL.items())
                          + f" FROM readings WINDOW w AS ({_W})"))
def fill_gaps(spark, sf_dir):
    return rounded(pr.fill_gaps(readings(spark, sf_dir), READINGS).select("event_id", "system_id", *GAPPY))


@query("encode_label", with_(R, select="SELECT event_id, fault_type, CAST(dense_rank() OVER (ORDER BY fault_type) - 1 "
                             "AS INTEGER) AS label_index FROM readings"))
def encode_label(spark, sf_dir):
    return pr.encode_label(readings(spark, sf_dir), "fault_type").select("event_id", "fault_type", "label_index")


SPLIT = ("parts", "SELECT *, CASE WHEN rn <= ceil(0.2e0 * n) THEN 'test' ELSE 'train' END AS split FROM (SELECT *, "
         "row_number() OVER (PARTITION BY fault_type ORDER BY md5(concat(CAST(event_id AS VARCHAR), '-42')), event_id) AS rn, "
         "count(*) OVER (PARTITION BY fault_type) AS n FROM readings) t")


@query("stratified_split", with_(R, SPLIT, select="SELECT event_id, fault_type, split FROM parts"))
def stratified_split(spark, sf_dir):
    return pr.stratified_split(readings(spark, sf_dir), "fault_type", "event_id").select("event_id", "fault_type", "split")


_STATS = ("stats", "SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in SENSORS)
          + " FROM parts WHERE split = 'train'")


@query("standardize", with_(R, SPLIT, _STATS, select="SELECT event_id, split, " + ", ".join(
    r6(f"({c} - {c}_m) / CASE WHEN {c}_s = 0 THEN 1e0 ELSE {c}_s END", c) for c in SENSORS)
    + " FROM parts CROSS JOIN stats"))
def standardize(spark, sf_dir):
    split = pr.stratified_split(readings(spark, sf_dir), "fault_type", "event_id")
    return rounded(pr.standardize(split, SENSORS).select("event_id", "split", *SENSORS))


@query("align_features", with_(R, select="SELECT event_id, speed, 0e0 AS oil_pressure, voltage, 0e0 AS rotor_speed, current "
                               "FROM readings"))
def align_features(spark, sf_dir):
    names = ["speed", "oil_pressure", "voltage", "rotor_speed", "current"]
    return pr.align_features(readings(spark, sf_dir), names, keep=["event_id"])


@query("class_weights", with_(R, select="SELECT fault_type, count(*) AS n, "
       + r6("sum(count(*)) OVER () / (count(*) OVER () * count(*))", "weight") + " FROM readings GROUP BY 1"))
def class_weights(spark, sf_dir):
    return rounded(pr.class_weights(readings(spark, sf_dir), "fault_type"))


@query("risk_level", with_(R, select=f"SELECT event_id, {RISK_SQL.format('fault_type')} AS risk_level FROM readings"))
def risk_level_query(spark, sf_dir):
    return readings(spark, sf_dir).select("event_id", risk_level("fault_type").alias("risk_level"))


@query("recommendation", with_(R, select=f"SELECT event_id, {ADVICE_SQL.format('fault_type')} AS recommendation FROM readings"))
def recommendation_query(spark, sf_dir):
    return readings(spark, sf_dir).select("event_id", recommendation("fault_type").alias("recommendation"))


@query("join_lookup", with_(R, select=f"SELECT event_id, {RISK_SQL.format('fault_type')} AS risk_level, "
                            f"{ADVICE_SQL.format('fault_type')} AS recommendation FROM readings"))
def join_lookup_query(spark, sf_dir):
    return join_lookup(readings(spark, sf_dir).select("event_id", "fault_type"), "fault_type").drop("fault_type")


def _noise(c: str, std: float) -> str:
    h = f"md5(concat(CAST(event_id AS VARCHAR), '-{c}-7'))"
    u = lambda s: f"((CAST(concat('0x', substr({h}, {s}, 8)) AS BIGINT) + 0.5e0) / 4294967296e0)"
    return f"{c} + sqrt(-2e0 * ln({u(1)})) * cos(2e0 * pi() * {u(9)}) * {std * 0.5!r}::DOUBLE"


@query("augment_noise", with_(R, select="SELECT event_id, " + ", ".join(
    r6(_noise(c, s), c) for c, s in pr.NOISE_STD.items()) + " FROM readings"))
def augment_noise(spark, sf_dir):
    out = pr.augment_noise(readings(spark, sf_dir), 0.5, key="event_id", seed=7)
    return rounded(out.select("event_id", *pr.NOISE_STD))


_MD5 = "md5(concat(CAST(event_id AS VARCHAR), '-{0}'))"


@query("shuffle_rows", with_(R, select=f"SELECT event_id, system_id, {_MD5.format(42)} AS shuffle_key FROM readings ORDER BY 3"))
def shuffle_rows(spark, sf_dir):
    return pr.shuffle_rows(readings(spark, sf_dir).select("event_id", "system_id"), "event_id")


@query("random_sample", with_(R, select=f"SELECT event_id, system_id FROM readings ORDER BY {_MD5.format(0)}, event_id LIMIT 80"))
def random_sample(spark, sf_dir):
    return pr.random_sample(readings(spark, sf_dir).select("event_id", "system_id"), "event_id", 80)


@query("union_sources", with_(R, select="SELECT event_id, system_id, speed, CAST(NULL AS DOUBLE) AS voltage FROM readings "
       "UNION ALL SELECT event_id, system_id, CAST(NULL AS DOUBLE), voltage FROM readings"))
def union_sources(spark, sf_dir):
    df = readings(spark, sf_dir)
    return mixes.union_sources(df.select("event_id", "system_id", "speed"), df.select("event_id", "system_id", "voltage"))


def _mix(counts: dict, seed: int) -> str:
    pick = " OR ".join(f"(fault_type = '{c}' AND i < {n})" for c, n in counts.items())
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fault_type ORDER BY {_MD5.format(seed)}, event_id) - 1 "
            f"AS i FROM readings) t WHERE {pick}")


_CLASSES_HERE = ("Battery Fault", "GPS Fault", "Motor Overheating", "Normal", "Sensor Drift")


@query("mix_datasets", with_(R,
       ("fleet", _mix({c: 200 for c in _CLASSES_HERE}, 21)),
       ("healthy", _mix({c: 800 if c == "Normal" else 25 for c in _CLASSES_HERE}, 31)),
       ("critical", _mix({"Normal": 800, "Motor Overheating": 10, "Battery Fault": 10}, 41)),
       ("degrading", _mix({"Normal": 600, "Sensor Drift": 600}, 51)),
       select=f"""
SELECT 'fleet_10x' AS slug, event_id, concat('FLEET-', lpad(CAST(i // 20 + 1 AS VARCHAR), 2, '0')) AS system_id, fault_type, ts FROM fleet
UNION ALL SELECT 'mostly_healthy', event_id, 'PROD-01', fault_type, ts FROM healthy
UNION ALL SELECT 'rare_critical', event_id, 'PROD-02', fault_type, ts FROM critical
UNION ALL SELECT 'long_degradation', event_id, 'RUL-01', fault_type, TIMESTAMP '2025-01-01 00:00:00'
  + to_seconds(row_number() OVER (ORDER BY fault_type, {_MD5.format(51)}, event_id) - 1) FROM degrading"""))
def mix_datasets(spark, sf_dir):
    built = mixes.standard_mixes(readings(spark, sf_dir), READINGS)
    out = [df.select(F.lit(slug).alias("slug"), "event_id", "system_id", "fault_type", "ts") for slug, df in built.items()]
    return mixes.union_sources(*out)


@query("dataset_catalog", with_(R, ("healthy", _mix({c: 800 if c == "Normal" else 25 for c in _CLASSES_HERE}, 31)),
       select="SELECT 'mostly_healthy' AS slug, count(*) AS rows, CAST(1 AS BIGINT) AS systems, count(DISTINCT fault_type) AS classes, "
       "true AS present FROM healthy UNION ALL SELECT 'readings', count(*), count(DISTINCT system_id), count(DISTINCT fault_type), "
       "true FROM readings UNION ALL SELECT 'absent', 0, 0, 0, false"))
def dataset_catalog(spark, sf_dir):
    df = readings(spark, sf_dir)
    tables = {"mostly_healthy": mixes.standard_mixes(df, READINGS)["mostly_healthy"], "readings": df, "absent": None}
    return mixes.dataset_catalog(spark, tables, READINGS).select("slug", "rows", "systems", "classes", "present")
