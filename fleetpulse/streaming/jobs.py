"""Streaming forms of scoring, alarms, rolling features, windows and drift.

Functions named `…_stream` turn one streaming DataFrame into another; `run_to_table` drives
a query over all available input into a Parquet table under the shared folder.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetpulse.functions.lookups import risk_level
from fleetpulse.operators.drift import drift_report
from fleetpulse.operators.metrics import predict_argmax
from fleetpulse.plans.scoring import alarms, prediction_records
from fleetpulse.schema import ROLLING_SENSORS, ReadingSchema, rolling_columns
from fleetpulse.session import scratch_path

# Sensors and length of the live view.
LIVE_SENSORS = ("motor_temperature", "battery_level", "voltage", "current", "vibration_x", "vibration_y",
                "vibration_z", "gps_accuracy", "signal_strength", "speed")
LIVE_ROWS = 120


def file_stream(spark: SparkSession, path: str, schema: T.StructType | None = None, files_per_batch: int = 64) -> DataFrame:
    """Parquet folder (or single file) as a stream. The limit per micro-batch bounds what one task of the
    per-system jobs can receive, also while a backlog is worked off."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    # a pattern that matches just this path: the file source takes plain paths for folders only
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_table(stream: DataFrame, name: str, mode: str = "append",
                 per_batch: Callable[[DataFrame, int, str], None] | None = None) -> DataFrame:
    """Run over all available input into a new Parquet table and return it.

    Append queries use the transactional file sink. Otherwise `per_batch(df, batch_id, path)` writes
    each micro-batch below `path/batch=<id>`; overwriting that folder makes a replayed batch harmless.
    """
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-offsets")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append" and per_batch is None:
        query = writer.format("parquet").option("path", path).start()
    else:
        write = per_batch or (lambda df, i, p: df.write.mode("overwrite").parquet(f"{p}/batch={i}"))
        query = writer.foreachBatch(lambda df, i: write(df, i, path)).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def newest(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last written version of each key of an update-mode table."""
    values = [c for c in table.columns if c not in (*keys, "batch")]
    last = table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, "v.*")


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], classes: Sequence[str],
                 schema: ReadingSchema) -> DataFrame:
    """Each reading with its prediction and the sensors a live view shows."""
    out = predict_argmax(score(stream), classes)
    return out.select(
        F.col(schema.tie), F.col(schema.ts).alias("t"), F.col(schema.system), F.col(schema.label).alias("actual_fault"),
        "predicted_fault", F.array_max("probs").alias("confidence"), risk_level("predicted_fault").alias("risk_level"),
        F.struct(*LIVE_SENSORS).alias("sensors"))


def alarm_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], classes: Sequence[str],
                 schema: ReadingSchema) -> DataFrame:
    """Alarms of high and critical predictions, as they arrive."""
    return alarms(prediction_records(score(stream), classes, schema), schema, source="live")


def recent_stream(stream: DataFrame, schema: ReadingSchema, columns: Sequence[str], n: int = LIVE_ROWS) -> DataFrame:
    """The last n readings of each system, re-emitted whenever a system has news (update mode).

    State per system is at most n rows.
    """
    fields = [schema.ts, schema.tie, *columns]
    slim = stream.select(schema.system, *fields)
    out_schema = T.StructType([slim.schema[schema.system], *[slim.schema[f] for f in fields]])
    state_schema = T.StructType([T.StructField("blob", T.BinaryType())])

    def keep(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = pickle.loads(state.get[0]) if state.exists else None
        for pdf in batches:  # never more than n rows and one batch at a time
            pdf = pdf[fields] if kept is None else pd.concat([kept, pdf[fields]])
            kept = pdf.sort_values([schema.ts, schema.tie]).tail(n)
        state.update((pickle.dumps(kept),))
        yield kept.assign(**{schema.system: key[0]})[[schema.system, *fields]]

    return slim.groupBy(schema.system).applyInPandasWithState(
        keep, out_schema, state_schema, "update", GroupStateTimeout.NoTimeout)


def rolling_statistics(values: np.ndarray, place: np.ndarray, window: int, block: int = 1 << 13) -> np.ndarray:
    """Mean, standard deviation, range and energy of each column of `values` over a row and up to window − 1 rows before
    it, no more than `place`: the row's number in its own series. Four columns per column.

    As pandas' rolling frames with one value at least: only finite values (squares, for the energy) count; without any,
    mean and energy are NaN and the other two 0, like the deviation of a single value. `block` rows are taken at once.
    """
    n, width = values.shape
    out = np.empty((n, width, 4))
    frame = np.full((window - 1 + n, width), np.nan)
    frame[window - 1:] = values
    views = np.lib.stride_tricks.sliding_window_view(frame, window, axis=0)
    back = np.arange(window - 1, -1, -1)
    with np.errstate(all="ignore"):
        for at in range(0, n, block):
            own = back <= place[at: at + block, None]
            view = np.where(own[:, None, :], views[at: at + block], np.nan)
            known = np.isfinite(view)
            count = known.sum(axis=2)
            mean = np.where(known, view, 0.0).sum(axis=2) / count
            low, high = np.where(known, view, np.inf).min(axis=2), np.where(known, view, -np.inf).max(axis=2)
            apart = np.where(known, view - mean[..., None], 0.0)
            std = np.sqrt((apart * apart).sum(axis=2) / (count - 1))
            squares = view * view
            finite = np.isfinite(squares)
            energy = np.where(finite.any(axis=2), np.where(finite, squares, 0.0).sum(axis=2), np.nan)
            part = out[at: at + block]
            part[..., 0] = mean
            part[..., 1] = np.where((count < 2) | (low == high), 0.0, std)
            part[..., 2] = np.where(count > 0, high - low, 0.0)
            part[..., 3] = energy
    return out.reshape(n, width * 4)


ROLLING_GROUPS = 1024       # systems are dealt to so many groups: for Spark a group costs as much as thousands of rows


def rolling_stream(stream: DataFrame, schema: ReadingSchema, window: int = 10,
                   sensors: Sequence[str] = ROLLING_SENSORS) -> DataFrame:
    """Rolling statistics of each arriving reading, from the last window−1 readings kept per system.

    Within a micro-batch a system's readings are taken in time order; across batches in the order
    of arrival. State per system is window−1 rows; the systems of a group (by hash) are taken and kept together.
    """
    sensors = list(sensors)
    names = rolling_columns(window, sensors)
    slim = stream.select(F.pmod(F.xxhash64(schema.system), F.lit(ROLLING_GROUPS)).alias("__group"), schema.system, schema.ts, schema.tie, *sensors)
    out_schema = T.StructType([slim.schema[schema.system], slim.schema[schema.tie],
                               *[T.StructField(c, T.DoubleType()) for c in names]])
    state_schema = T.StructType([T.StructField("blob", T.BinaryType())])

    def roll(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches)).sort_values([schema.ts, schema.tie])
        systems, values = new[schema.system].to_numpy(dtype=object), new[sensors].to_numpy(dtype=float)
        tail = 0
        if state.exists:
            kept_systems, kept = pickle.loads(state.get[0])
            tail = len(kept)
            systems, values = np.concatenate([kept_systems, systems]), np.concatenate([kept, values])
        code = pd.factorize(systems, use_na_sentinel=False)[0]
        order = np.argsort(code, kind="stable")             # what was kept comes first in its system
        code, values = code[order], values[order]
        first = np.searchsorted(code, code, "left")
        place = np.arange(len(code)) - first
        last = np.searchsorted(code, code, "right") - np.arange(len(code)) < window
        state.update((pickle.dumps((systems[order[last]], values[last])),))
        rows = order >= tail
        out = pd.DataFrame(rolling_statistics(values, place, window)[rows], columns=names)
        out.insert(0, schema.tie, new[schema.tie].to_numpy()[order[rows] - tail])
        out.insert(0, schema.system, systems[order[rows]])
        yield out

    return slim.groupBy("__group").applyInPandasWithState(
        roll, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def _event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    return stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", delay)


def fault_rate_stream(stream: DataFrame, schema: ReadingSchema, length: str = "1 day", slide: str | None = None,
                      delay: str = "1 hour") -> DataFrame:
    """Readings per fault in tumbling (or sliding) event-time windows; partial counts before the exchange."""
    span = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    counted = _event_time(stream, schema.ts, delay).groupBy(span, schema.label).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                          schema.label, "count")


def fault_session_stream(stream: DataFrame, schema: ReadingSchema, gap: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Fault periods per system: non-Normal readings at most `gap` apart."""
    faults = _event_time(stream, schema.ts, delay).where(F.col(schema.label) != "Normal")
    grouped = faults.groupBy(F.session_window("event_time", gap), schema.system, schema.label).agg(
        F.count(F.lit(1)).alias("count"))
    return grouped.select(schema.system, schema.label, F.col("session_window.start").alias("start_ts"),
                          F.col("session_window.end").alias("end_ts"), "count")


def drift_stream(stream: DataFrame, reference: DataFrame, schema: ReadingSchema, features: Sequence[str], name: str) -> DataFrame:
    """A drift report of every micro-batch against the reference snapshot."""
    def write(df: DataFrame, batch: int, path: str) -> None:
        drift_report(reference, df, schema, features).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return run_to_table(stream, name, per_batch=write)


def join_static(stream: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Stream–static join; Spark broadcasts the static side only while it is below its size threshold."""
    return stream.join(table, key, "left")

