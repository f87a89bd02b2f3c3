"""Tables written out and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.catalog.features import FUSED_CTES, FUSED_FEATURES
from fleetpulse.catalog.ranking import LIN, RECORD_SQL, batch_records
from fleetpulse.catalog.registry import query, r6, with_
from fleetpulse.catalog.views import READINGS, R, readings, table
from fleetpulse.functions.scalars import rounded
from fleetpulse.plans.fused import fused_frame
from fleetpulse.schema import SENSORS, ReadingSchema
from fleetpulse.session import scratch_path, written
from fleetpulse.sources import files as fs
from fleetpulse.sources import registry as rg


@query("read_readings_csv", with_(R, select="SELECT event_id, ts, system_id, fault_type, " + ", ".join(r6(s, s) for s in SENSORS) + " FROM readings"))
def read_readings_csv(spark, sf_dir):
    path = fs.write_table(readings(spark, sf_dir), scratch_path(spark, "readings-csv"))
    out = fs.read_readings_csv(spark, path, READINGS)
    return rounded(out.select("event_id", "ts", "system_id", "fault_type", *SENSORS))


TF_COLS = fs.TURBOFAN_COLUMNS[2:]
_src = {c: f"({SENSORS[i % 16]} * {i + 1})" for i, c in enumerate(TF_COLS)}
_UNIT = "CAST(substr(system_id, 5) AS INTEGER)"
TF = (R, ("cyc", f"SELECT *, {_UNIT} AS unit, CAST(row_number() OVER (PARTITION BY system_id ORDER BY ts, event_id) AS INTEGER) AS cycle FROM readings"),
      ("life", "SELECT *, max(cycle) OVER (PARTITION BY unit) - cycle AS rul FROM cyc"))


@query("adapt_turbofan", with_(*TF, select="SELECT TIMESTAMP '2025-01-01 00:00:00' + to_seconds(cycle) AS timestamp, concat('CMAPSS-', "
       "CASE WHEN length(CAST(unit AS VARCHAR)) < 3 THEN lpad(CAST(unit AS VARCHAR), 3, '0') ELSE CAST(unit AS VARCHAR) END) AS system_id, "
       "CAST(unit AS BIGINT) * 1048576 + cycle AS row_id, CASE WHEN rul <= 50 THEN 'Motor Overheating' ELSE 'Normal' END AS fault_type, "
       + ", ".join(r6(_src[fs.TURBOFAN_SENSORS[s]], s) for s in SENSORS) + " FROM life"))
def adapt_turbofan(spark, sf_dir):
    return rounded(fs.adapt_turbofan(spark.read.text(turbofan_text(spark, sf_dir))))


def turbofan_text(spark, sf_dir):
    from fleetpulse.operators.ordering import positions

    df = positions(readings(spark, sf_dir), "system_id", ["ts", "event_id"], "cycle", "n")
    text = F.concat_ws("   ", F.expr(f"CAST({_UNIT} AS STRING)"), (F.col("cycle") + 1).cast("string"),
                       *[F.expr(f"coalesce(CAST({e} AS STRING), 'NaN')") for e in _src.values()])
    path = scratch_path(spark, "turbofan")
    df.select(text.alias("value")).write.text(path)
    return path


@query("csv_to_fused", with_(*FUSED_CTES, select="SELECT ts, system_id, fault_type, " + ", ".join(r6(n, n) for n in FUSED_FEATURES) + " FROM fused"))
def csv_to_fused(spark, sf_dir):
    """Readings from a CSV file without a key and with a column of its own, straight into the feature frame."""
    df = readings(spark, sf_dir).drop("event_id").withColumn("note", F.lit("x"))
    df = fs.read_readings_csv(spark, fs.write_table(df, scratch_path(spark, "readings-csv")), ReadingSchema(ts="ts"))
    df = written(df, "readings-rows")       # the feature frame reads its input several times
    return rounded(fused_frame(df, ReadingSchema(ts="ts")).select("ts", "system_id", "fault_type", *FUSED_FEATURES))


_TF = [(n.replace("readings", "src"), s.replace("FROM readings", "FROM src")) for n, s in TF]
_TF_READINGS = ("readings", "SELECT TIMESTAMP '2025-01-01 00:00:00' + to_seconds(cycle) AS ts, CAST(unit AS BIGINT) * 1048576 + cycle AS event_id, "
                "concat('CMAPSS-', CASE WHEN length(CAST(unit AS VARCHAR)) < 3 THEN lpad(CAST(unit AS VARCHAR), 3, '0') ELSE CAST(unit AS VARCHAR) END) "
                "AS system_id, CASE WHEN rul <= 50 THEN 'Motor Overheating' ELSE 'Normal' END AS fault_type, "
                + ", ".join(f"{_src[fs.TURBOFAN_SENSORS[s]]} AS {s}" for s in SENSORS) + " FROM life")


@query("turbofan_to_fused", with_(*_TF, _TF_READINGS, *[c for c in FUSED_CTES if c[0] != "readings"],
                                  select="SELECT event_id AS row_id, ts AS timestamp, system_id, fault_type, "
                                  + ", ".join(r6(f"{n} * 1e-6" if "energy" in n else n, n) for n in FUSED_FEATURES) + " FROM fused"))
def turbofan_to_fused(spark, sf_dir):
    df = fs.adapt_turbofan(spark.read.text(turbofan_text(spark, sf_dir)))
    out = fused_frame(df, ReadingSchema()).select("row_id", "timestamp", "system_id", "fault_type", *FUSED_FEATURES)
    return rounded(out.withColumns({n: F.col(n) * 1e-6 for n in FUSED_FEATURES if "energy" in n}))  # sums of squares near 1e8


MACHINE = {
    "UDI": "event_id + 1", "Product ID": "concat('M', CAST(event_id AS STRING))",
    "Type": "CASE event_id % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'M' ELSE 'H' END",
    "Air temperature [K]": "2.95e2 + speed / 5e0", "Process temperature [K]": "2.4e2 + motor_temperature",
    "Rotational speed [rpm]": "1.2e3 + heading", "Torque [Nm]": "3e1 + gps_accuracy", "Tool wear [min]": "coalesce(battery_level, 0e0) * 2e0",
    "Machine failure": "CASE WHEN fault_type = 'Normal' THEN 0 ELSE 1 END", "TWF": "CASE WHEN fault_type = 'Sensor Drift' THEN 1 ELSE 0 END",
    "HDF": "CASE WHEN fault_type = 'Motor Overheating' THEN 1 ELSE 0 END", "PWF": "CASE WHEN fault_type = 'Battery Fault' THEN 1 ELSE 0 END",
    "OSF": "CASE WHEN fault_type IN ('GPS Fault', 'Motor Overheating') THEN 1 ELSE 0 END",
    "RNF": "CASE WHEN gps_satellite_count = 2e0 THEN 1 ELSE 0 END",
}
MILL = (R, ("mill", "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in MACHINE.items()) + " FROM readings"),
        ("ms", 'SELECT avg("Rotational speed [rpm]") AS rm, stddev_samp("Rotational speed [rpm]") AS rs, avg("Torque [Nm]") AS tm, '
         'stddev_samp("Torque [Nm]") AS td FROM mill'))
_LABEL = "CASE WHEN \"Machine failure\" = 0 THEN 'Normal' " + " ".join(f"WHEN {c} = 1 THEN '{f}'" for c, f in fs.MACHINING_FAULTS.items()) + " ELSE 'Normal' END"
_ZT = '(("Torque [Nm]" - tm) / greatest(td, 1e-6))'


def machining_csv(spark, sf_dir):
    df = readings(spark, sf_dir).selectExpr(*[f"{e} AS `{n}`" for n, e in MACHINE.items()]).withColumnRenamed("UDI", "﻿UDI ")
    path = fs.write_table(df, scratch_path(spark, "machining"))
    return spark.read.option("header", True).csv(path)


@query("adapt_machining", with_(*MILL, select='SELECT "UDI" AS row_id, TIMESTAMP \'2025-01-01 00:00:00\' + to_minutes("UDI" - 1) AS timestamp, '
       "concat('AI4I-TYPE-', \"Type\") AS system_id, " + ", ".join([
           r6('"Process temperature [K]" - 273.15e0', "motor_temperature"),
           r6('least(greatest(1e2 - "Tool wear [min]" * 0.4e0, 2e1), 1e2)', "battery_level"),
           r6('23.5e0 + ("Rotational speed [rpm]" - rm) / rs * 0.4e0', "voltage"), r6(f"11e0 + {_ZT} * 1.5e0", "current"),
           r6(f"abs(0.15e0 + {_ZT} * 0.05e0)", "vibration_x"), "0.15e0 AS vibration_y, 0.15e0 AS vibration_z, 0e0 AS acceleration_x, "
           "0e0 AS acceleration_y, 9.81e0 AS acceleration_z, 2e0 AS gps_accuracy, 12e0 AS gps_satellite_count, -6e1 AS signal_strength",
           r6('"Air temperature [K]" - 273.15e0', "altitude"), r6('"Rotational speed [rpm]" / 1e2', "speed"), "1.8e2 AS heading"])
       + f", {_LABEL} AS fault_type FROM mill CROSS JOIN ms"))
def adapt_machining(spark, sf_dir):
    return rounded(fs.adapt_machining(machining_csv(spark, sf_dir)))


@query("machining_label", with_(*MILL[:2], select=f'SELECT "UDI" AS udi, {_LABEL} AS fault_type FROM mill'))
def machining_label(spark, sf_dir):
    df = fs.clean_headers(machining_csv(spark, sf_dir))
    return df.select(F.col("UDI").cast("long").alias("udi"), fs.machining_label(df).alias("fault_type"))


@query("read_runs", "SELECT CAST(event_id AS VARCHAR) AS run_id, event_type AS kind, CAST(event_id + 1000000 AS VARCHAR) AS timestamp, "
       "CAST(user_id AS VARCHAR) AS metric_user, json_extract_string(props, '$.k') AS param_k FROM events")
def read_runs(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("kind"),
        (F.col("event_id") + 1000000).cast("string").alias("timestamp"),
        F.from_json("props", "map<string,string>").alias("params"), F.create_map(F.lit("user"), "user_id").alias("metrics")))
    path = scratch_path(spark, "runs")
    ev.select(line.alias("value")).write.text(path)
    spark.createDataFrame([("",), ("{not json",)], "value string").write.mode("append").text(path)
    return fs.read_runs(spark, path).toDF("run_id", "kind", "timestamp", "metric_user", "param_k")


@query("append_run", "SELECT 'train' AS kind, '7' AS models, NULL AS n_features, CAST(count(*) AS VARCHAR) AS rows FROM events "
       "UNION ALL SELECT 'drift', NULL, '61', CAST(count(*) AS VARCHAR) FROM events")
def append_run(spark, sf_dir):
    """Two entries with figures of the events table, read back without their random ids."""
    path = scratch_path(spark, "runlog")
    n = table(spark, sf_dir, "events").count()
    fs.append_run(spark, path, "train", {"models": 7}, {"rows": n})
    fs.append_run(spark, path, "drift", {"n_features": 61}, {"rows": n})
    back = fs.read_runs(spark, path, ["rows"], ["models", "n_features"])
    return back.select("kind", F.col("`param.models`").alias("models"), F.col("`param.n_features`").alias("n_features"), F.col("`metric.rows`").alias("rows"))


@query("write_predictions", with_(*LIN, select=f"SELECT event_id, system_id, {RECORD_SQL} FROM rec"))
def write_predictions(spark, sf_dir):
    records = rounded(batch_records(spark, sf_dir)).drop("ts")
    path = fs.write_table(records, scratch_path(spark, "predictions"))
    back = spark.read.schema(records.schema).option("header", True).csv(path)
    return back.na.fill("")


@query("registry_retain", "SELECT CAST(event_id AS VARCHAR) AS version_id, event_type AS model_name FROM (SELECT *, row_number() OVER "
       "(ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn <= 10")
def registry_retain(spark, sf_dir):
    """The newest ten of an index with one entry per event."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("version_id"), F.col("event_type").alias("model_name"), F.col("ts").alias("created_at"),
        F.col("event_id").alias("tie"))
    return rg.newest_entries(ev, 10, tie="tie").select("version_id", "model_name")
