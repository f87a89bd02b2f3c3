"""From scored rows to prediction records and alarms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.lookups import ALARM_RISKS, recommendation, risk_level
from fleetpulse.operators.metrics import apply_thresholds, predict_argmax
from fleetpulse.schema import ReadingSchema


def prediction_records(scored: DataFrame, classes: Sequence[str], schema: ReadingSchema,
                       thresholds=None, actual: bool = False) -> DataFrame:
    """Records with keys, fault, confidence, risk and advice. Keys travel with the rows; nothing is glued by position."""
    keys = [c for c in (schema.tie, schema.ts, schema.system) if c in scored.columns]
    pick = predict_argmax(scored, classes) if thresholds is None else apply_thresholds(scored, classes, thresholds)
    out = pick.withColumns({
        "confidence": F.array_max("probs"), "risk_level": risk_level("predicted_fault"),
        "recommendation": recommendation("predicted_fault")})
    cols = [*keys, "predicted_fault", "confidence", "risk_level", "recommendation"]
    if not actual:
        return out.select(*cols)
    out = out.withColumns({"actual_fault": F.col(schema.label), "correct": F.col(schema.label) == F.col("predicted_fault")})
    return out.select(*keys, "actual_fault", *cols[len(keys):], "correct")


def join_predictions(readings: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Readings with their predictions, on the row key."""
    return readings.join(predictions, key)


def alarms(records: DataFrame, schema: ReadingSchema, source: str = "prediction") -> DataFrame:
    """Records of high or critical risk, with the text a chat hook would post."""
    hit = records.where(F.col("risk_level").isin(*ALARM_RISKS))
    out = hit.select(
        F.col(schema.tie), F.col(schema.ts).alias("timestamp"), F.col(schema.system).alias("system_id"),
        F.col("predicted_fault").alias("fault"), F.col("risk_level").alias("risk"), "confidence", "recommendation",
        F.lit(source).alias("source"))
    text = F.concat(F.lit(":rotating_light: "), F.col("fault"), F.lit(" ("), F.col("risk"), F.lit(") on "),
                    F.coalesce("system_id", F.lit("unknown system")))
    alarm = F.struct("timestamp", "system_id", "fault", "risk", "confidence", "recommendation", "source")
    return out.withColumn("payload", F.to_json(F.struct(text.alias("text"), alarm.alias("alarm"))))


def latest_alarms(table: DataFrame, tie: str, limit: int = 200) -> DataFrame:
    return table.orderBy(F.desc("timestamp"), F.desc(tie)).limit(limit)
