import pytest
from pyspark.sql import functions as F

from fleetpulse.catalog.views import READINGS
from fleetpulse.schema import SENSORS, ReadingSchema, meta_first, missing_columns, numeric_features, rolling_columns
from fleetpulse.session import scratch_path
from fleetpulse.sources import files as fs
from fleetpulse.sources import mixes


def write(spark, lines, name="f"):
    path = scratch_path(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_schema_helpers(readings):
    assert missing_columns(readings, READINGS) == []
    assert missing_columns(readings.drop("speed", "ts"), READINGS) == ["speed", "ts"]
    assert meta_first(readings, READINGS).columns[:3] == ["ts", "system_id", "fault_type"]
    assert numeric_features(readings.withColumn("note", F.lit("x")), READINGS) == list(SENSORS)
    with pytest.raises(ValueError):
        numeric_features(readings.select("ts", "fault_type"), READINGS)
    assert len(rolling_columns(10)) == 32


def test_bad_csv_is_refused(spark):
    for lines in ([], ["only"], ["a,b"]):
        with pytest.raises(ValueError):
            fs.read_readings_csv(spark, write(spark, lines))


def test_csv_coerces_times_and_nan(spark):
    path = write(spark, ["timestamp,speed,voltage", "2025-01-01 00:00:01,1.5,NaN", "not a time,2.5,7"])
    rows = {r["speed"]: r for r in fs.read_readings_csv(spark, path).collect()}
    assert rows[1.5]["voltage"] is None and rows[1.5]["timestamp"] is not None
    assert rows[2.5]["timestamp"] is None and rows[2.5]["system_id"] == "SYS-01"


def test_turbofan_labels_last_cycles(spark):
    lines = [f"{u}  {c}   " + "  ".join(str(round(u + c * 0.1 + i, 3)) for i in range(24)) for u in (1, 2, 3) for c in range(1, 60)]
    out = fs.adapt_turbofan(spark.read.text(write(spark, [*lines, "  "])))
    assert out.count() == 177
    one = out.where("system_id = 'CMAPSS-001'").orderBy("row_id").collect()
    assert one[0]["fault_type"] == "Normal" and one[-1]["fault_type"] == "Motor Overheating"
    assert one[0]["motor_temperature"] == pytest.approx(1 + 0.1 + 4) and set(SENSORS) <= set(out.columns)
    assert not {"unit", "cycle"} & set(out.columns) and out.select("row_id").distinct().count() == 177


def test_csv_keeps_known_types_and_gets_a_key(spark):
    path = write(spark, ["timestamp,system_id,speed,note", "2025-01-01 00:00:01,0012,1,7", "2025-01-01 00:00:02,0012,2,8"])
    out = fs.read_readings_csv(spark, path)
    assert dict(out.dtypes) | {"note": "int"} == dict(out.dtypes) and dict(out.dtypes)["speed"] == "double"
    assert {r["system_id"] for r in out.collect()} == {"0012"} and out.select("row_id").distinct().count() == 2


def test_machining_labels(spark):
    head = ("﻿UDI,Product ID,Type,Air temperature [K],Process temperature [K],Rotational speed [rpm],Torque [Nm],"
            "Tool wear [min],Machine failure,TWF,HDF,PWF,OSF,RNF")
    rows = ["1,M1,M,298,308,1500,40,0,0,0,0,0,0,0", "2,L1,L,298,309,1400,45,250,1,0,1,0,1,0",
            "3,H1,H,299,310,1600,35,10,0,0,0,0,0,1", "4,L2,L,299,310,1550,42,20,1,0,0,0,0,1"]
    raw = spark.read.option("header", True).csv(write(spark, [head, *rows]))
    out = {r["row_id"]: r for r in fs.adapt_machining(raw).collect()}
    assert [out[i]["fault_type"] for i in (1, 2, 3, 4)] == ["Normal", "Motor Overheating", "Normal", "Communication Fault"]
    assert out[2]["battery_level"] == 20.0 and out[1]["system_id"] == "AI4I-TYPE-M"
    assert out[1]["motor_temperature"] == pytest.approx(308 - 273.15)


def test_run_log_skips_malformed(spark):
    path = scratch_path(spark, "runs")
    fs.append_run(spark, path, "train", {"models": 3}, {"f1": 0.5})
    fs.append_run(spark, path, "drift", {"n": 2}, {"overall": "stable"})
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    out = fs.read_runs(spark, path)
    assert out.count() == 2 and {"metric.f1", "metric.overall", "param.models"} <= set(out.columns)


def test_mixes_have_exact_sizes(readings):
    built = mixes.standard_mixes(readings, READINGS)
    rare = {r["fault_type"]: r["count"] for r in built["rare_critical"].groupBy("fault_type").count().collect()}
    assert rare["Motor Overheating"] == rare["Battery Fault"] == 10
    series = built["long_degradation"].orderBy("ts").select("fault_type", "ts").collect()
    labels = [r[0] for r in series]
    assert labels == sorted(labels) and (series[1]["ts"] - series[0]["ts"]).total_seconds() == 1
    assert built["fleet_10x"].select("system_id").distinct().count() <= 10
    assert ReadingSchema().meta == ("timestamp", "system_id", "fault_type")


def test_turbofan_text_is_parsed_once(spark):
    """What stands on the adapted readings reads parsed rows, not the text again."""
    path = scratch_path(spark, "turbofan-lines")
    spark.createDataFrame([(f"{u}  {c} " + " ".join(str(u + c + k / 4) for k in range(24)),) for u in (1, 2) for c in range(1, 60)], "value string").write.text(path)
    df = fs.adapt_turbofan(spark.read.text(path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("parquet") >= 1
    got = df.groupBy("system_id", "fault_type").count().collect()
    assert sorted(map(tuple, got)) == [("CMAPSS-001", "Motor Overheating", 51), ("CMAPSS-001", "Normal", 8),
                                       ("CMAPSS-002", "Motor Overheating", 51), ("CMAPSS-002", "Normal", 8)]
