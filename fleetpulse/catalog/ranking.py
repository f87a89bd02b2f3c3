"""Scoring with a fixed linear model, and explaining its scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.catalog.explore import RISK_SQL
from fleetpulse.catalog.metrics import PR, RECALL_T, _decide
from fleetpulse.catalog.prepare import ADVICE_SQL, FILL, SPLIT
from fleetpulse.catalog.registry import query, r6, with_
from fleetpulse.catalog.views import CLASSES, READINGS, R, readings, scored
from fleetpulse.functions.scalars import argmax, name_at, rounded
from fleetpulse.operators import attribution as at
from fleetpulse.operators import metrics as mt
from fleetpulse.operators import prepare as pr
from fleetpulse.operators.counterfactual import counterfactual, top_impacted
from fleetpulse.operators.linear import LinearModel, linear_attribution, linear_attribution_row
from fleetpulse.plans import scoring as sc

FEATURES = ["motor_temperature", "battery_level", "voltage", "current", "vibration_x", "gps_accuracy",
            "signal_strength", "speed"]
# coefficients by rule: any fixed numbers without ties will do
WEIGHTS = [[round(((7919 * (c + 1) * (j + 3) + 31 * c * c) % 1009) / 1009 - 0.5, 6) for j in range(len(FEATURES))]
           for c in range(len(CLASSES))]
INTERCEPTS = [round(((104729 * (c + 2)) % 1009) / 1009 - 0.5, 6) for c in range(len(CLASSES))]
MODEL = LinearModel(tuple(CLASSES), tuple(FEATURES), tuple(map(tuple, WEIGHTS)), tuple(INTERCEPTS))
K, D = range(len(CLASSES)), range(len(FEATURES))
TARGET = CLASSES.index("Normal")

FILLED = ("filled", "SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in FILL.items())
          + ") FROM readings WINDOW w AS (PARTITION BY system_id ORDER BY ts, event_id)")
ZSTATS = ("zstats", "SELECT " + ", ".join(f"avg({f}) AS m{j}, stddev_pop({f}) AS s{j}" for j, f in enumerate(FEATURES)) + " FROM filled")
Z = ("z", "SELECT event_id, ts, system_id, fault_type, " + ", ".join(f"({f} - m{j}) / s{j} AS x{j}" for j, f in enumerate(FEATURES))
     + " FROM filled CROSS JOIN zstats")
_margin = lambda c: f"{INTERCEPTS[c]!r}e0 + " + " + ".join(f"({WEIGHTS[c][j]!r}e0) * x{j}" for j in D)
_softmax = ("SELECT *, " + ", ".join(f"e{c} / (" + " + ".join(f"e{i}" for i in K) + f") AS p{c}" for c in K) + " FROM (SELECT *, "
            + ", ".join(f"exp(m{c} - mx) AS e{c}" for c in K) + " FROM (SELECT *, greatest(" + ", ".join(f"m{c}" for c in K)
            + ") AS mx FROM {src}) q1) q2")
_pmax = "greatest(" + ", ".join(f"p{c}" for c in K) + ")"
_arg = "CASE " + " ".join(f"WHEN p{c} = {_pmax} THEN {c}" for c in K) + " END"
_argname = "CASE " + " ".join(f"WHEN p{c} = {_pmax} THEN '{CLASSES[c]}'" for c in K) + " END"
LIN = (R, FILLED, ZSTATS, Z, ("zm", "SELECT *, " + ", ".join(f"{_margin(c)} AS m{c}" for c in K) + " FROM z"),
       ("lin", _softmax.format(src="zm")),
       ("rec", f"SELECT *, {_argname} AS predicted_fault, {_pmax} AS confidence FROM lin"))


def features_z(spark, sf_dir):
    filled = pr.fill_gaps(readings(spark, sf_dir), READINGS, ["battery_level", "signal_strength"])
    return pr.standardize(filled, FEATURES, split=None).select("event_id", "ts", "system_id", "fault_type", *FEATURES)


def linear_scored(spark, sf_dir):
    return MODEL.probabilities(features_z(spark, sf_dir))


RECORD_SQL = (f"predicted_fault, {r6('confidence', 'confidence')}, {RISK_SQL.format('predicted_fault')} AS risk_level, "
              f"{ADVICE_SQL.format('predicted_fault')} AS recommendation")


def batch_records(spark, sf_dir):
    return sc.prediction_records(linear_scored(spark, sf_dir), CLASSES, READINGS)


@query("score_batch", with_(*LIN, select=f"SELECT event_id, ts, system_id, {RECORD_SQL} FROM rec"))
def score_batch(spark, sf_dir):
    return rounded(batch_records(spark, sf_dir))


@query("score_holdout", with_(*PR, RECALL_T, _decide("decided", "recall_t"), SPLIT, select=(
    "SELECT d.row_id AS event_id, ts, system_id, label AS actual_fault, predicted_fault, confidence, "
    f"{RISK_SQL.format('predicted_fault')} AS risk_level, {ADVICE_SQL.format('predicted_fault')} AS recommendation, "
    "label = predicted_fault AS correct FROM decided d JOIN parts ON d.row_id = event_id "
    "JOIN (SELECT row_id, max(p) AS confidence FROM scored GROUP BY 1) c ON c.row_id = d.row_id WHERE split = 'test'")))
def score_holdout(spark, sf_dir):
    df = scored(spark, sf_dir)
    thresholds = mt.thresholds_for_recall(df, CLASSES)
    split = pr.stratified_split(readings(spark, sf_dir), "fault_type", "event_id").where("split = 'test'")
    held = sc.join_predictions(split.select("event_id", "ts", "system_id", "fault_type"),
                               df.select(F.col("row_id").alias("event_id"), "probs"), "event_id")
    return sc.prediction_records(held, CLASSES, READINGS, thresholds, actual=True)


@query("join_predictions_to_readings", with_(*LIN, select="SELECT r.event_id, r.system_id, r.speed, predicted_fault FROM readings r "
                                             "JOIN rec ON r.event_id = rec.event_id"))
def join_predictions_to_readings(spark, sf_dir):
    preds = batch_records(spark, sf_dir).select("event_id", "predicted_fault")
    return sc.join_predictions(readings(spark, sf_dir).select("event_id", "system_id", "speed"), preds, "event_id")


ALARM_SQL = ("alarm_rows", f"SELECT event_id, ts AS timestamp, system_id, predicted_fault AS fault, {RISK_SQL.format('predicted_fault')} AS risk, "
             f"confidence, {ADVICE_SQL.format('predicted_fault')} AS recommendation FROM rec")


@query("latest_alarms", with_(*LIN, ALARM_SQL, select=f"SELECT event_id, timestamp, system_id, fault, risk, {r6('confidence', 'confidence')}, "
       "recommendation, 'prediction' AS source FROM alarm_rows WHERE risk IN ('High', 'Critical') "
       "ORDER BY alarm_rows.timestamp DESC, event_id DESC LIMIT 200"))
def latest_alarms(spark, sf_dir):
    table = sc.alarms(batch_records(spark, sf_dir), READINGS)
    return rounded(sc.latest_alarms(table, "event_id").drop("payload"))


def _phi(c, j):
    return f"({WEIGHTS[c][j]!r}e0) * (x{j} - a{j})"


ATTR = (*LIN, ("av", "SELECT " + ", ".join(f"avg(x{j}) AS a{j}" for j in D) + " FROM z"), ("attr", " UNION ALL ".join(
    f"SELECT event_id, '{CLASSES[c]}' AS class, '{FEATURES[j]}' AS feature, x{j} AS value, {_phi(c, j)} AS phi, "
    f"{INTERCEPTS[c]!r}e0 + " + " + ".join(f"({WEIGHTS[c][i]!r}e0) * a{i}" for i in D) + " AS base_value, predicted_fault FROM rec CROSS JOIN av"
    for c in K for j in D)))


def attributions(spark, sf_dir):
    df = linear_scored(spark, sf_dir)
    fault = name_at(CLASSES, argmax(F.col("probs"))).alias("predicted_fault")
    return linear_attribution(df.select("event_id", *FEATURES, fault), MODEL, ["event_id", "predicted_fault"],
                              means=features_z(spark, sf_dir))


@query("linear_attribution", with_(*ATTR, select="SELECT event_id, class, feature, " + r6("value", "value") + ", " + r6("phi", "phi")
                                   + ", " + r6("base_value", "base_value") + " FROM attr"))
def linear_attribution_query(spark, sf_dir):
    return rounded(attributions(spark, sf_dir).drop("predicted_fault"))


IMPORTANCE = ("imp", "SELECT feature, avg(abs(phi)) AS importance FROM attr GROUP BY 1")


@query("global_importance", with_(*ATTR, IMPORTANCE, select=f"SELECT feature, {r6('importance', 'importance')} FROM imp"))
def global_importance(spark, sf_dir):
    return rounded(at.global_importance(attributions(spark, sf_dir)))


@query("top_importance", with_(*ATTR, IMPORTANCE, select=f"SELECT feature, {r6('importance', 'importance')} FROM imp "
                               "ORDER BY imp.importance DESC, feature LIMIT 5"))
def top_importance(spark, sf_dir):
    return rounded(at.top_importance(at.global_importance(attributions(spark, sf_dir)), 5))


def of_prediction(spark, sf_dir):
    """One row per prediction with the contributions to its predicted class in an array."""
    df = linear_scored(spark, sf_dir)
    top = argmax(F.col("probs"))
    return linear_attribution_row(df.withColumn("predicted_fault", name_at(CLASSES, top)), MODEL, top, ["event_id", "predicted_fault"],
                                  means=features_z(spark, sf_dir))


RANKED = ("ranked", "SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(phi) DESC, feature) AS rank FROM attr "
          "WHERE class = predicted_fault")


@query("top_contributions", with_(*ATTR, RANKED, select="SELECT event_id, predicted_fault, feature, CAST(rank AS INTEGER) AS rank, "
       + r6("phi", "phi") + ", CASE WHEN phi >= 0 THEN 'Toward' ELSE 'Against' END AS direction FROM ranked WHERE rank <= 5"))
def top_contributions(spark, sf_dir):
    top = of_prediction(spark, sf_dir).select("event_id", "predicted_fault", F.inline(at.top_of_row(F.col("entries"), 5)))
    return rounded(top.select("event_id", "predicted_fault", "feature", "rank", "phi", "direction"))


@query("waterfall", with_(*ATTR, RANKED, ("bars", "SELECT event_id, least(rank, 6) AS slot, count(*) AS n, min(feature) AS feature, "
       "min(value) AS value, sum(phi) AS phi, min(base_value) AS base_value FROM ranked GROUP BY 1, 2"), select=(
    "SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS position, CASE WHEN slot = 6 THEN concat('Other (', CAST(n AS VARCHAR), ')') "
    "ELSE feature END AS feature, CASE WHEN slot < 6 THEN " + r6("value", "x").replace(" AS x", "") + " END AS value, " + r6("phi", "phi") + ", "
    + r6("base_value", "base_value") + ", " + r6("base_value + sum(phi) OVER (PARTITION BY event_id ORDER BY slot DESC)", "cumulative")
    + " FROM bars WHERE NOT (slot = 6 AND phi = 0) WINDOW w AS (PARTITION BY event_id ORDER BY slot DESC)")))
def waterfall(spark, sf_dir):
    return rounded(of_prediction(spark, sf_dir).select("event_id", F.inline(at.waterfall_of_row(F.col("entries"), F.col("base_value"), 5))))


STEP, ROUNDS = 0.3, 60

# a move's number, its change of every margin (moving feature j by v adds v·weight[c][j] to margin c) and of every feature
MOVES = ("moves", "SELECT * FROM (VALUES " + ", ".join(
    f"({2 * j + s}, " + ", ".join(f"{v * WEIGHTS[c][j]!r}::DOUBLE" for c in K) + ", " + ", ".join(f"{v if i == j else 0.0!r}::DOUBLE" for i in D) + ")"
    for j in D for s, v in enumerate((-STEP, STEP))) + ") t(mv, " + ", ".join(f"w{c}" for c in K) + ", " + ", ".join(f"v{j}" for j in D) + ")")


def _search_sql() -> tuple:
    """One recursion step is a round on margins; a row's last state is the one that is no longer active or of the last round."""
    margins, deltas = ", ".join(f"m{c}" for c in K), ", ".join(f"d{j}" for j in D)
    tries = ("SELECT event_id, round_no, orig, cls AS was, pt AS old, mv, " + ", ".join(f"m{c} + w{c} AS m{c}" for c in K) + ", "
             + ", ".join(f"d{j} + v{j} AS d{j}" for j in D) + ", " + ", ".join(f"m{c} AS a{c}" for c in K) + ", "
             + ", ".join(f"d{j} AS b{j}" for j in D) + f" FROM walk CROSS JOIN moves WHERE active AND round_no < {ROUNDS}")
    best = (f"SELECT *, p{TARGET} AS new, {_arg} AS found, row_number() OVER (PARTITION BY event_id ORDER BY p{TARGET} - old DESC, mv) AS rn "
            f"FROM ({_softmax.format(src=f'({tries}) t')}) u")
    kept = lambda now, before: f"CASE WHEN new > old THEN {now} ELSE {before} END"
    walk = (f"SELECT event_id, 0 AS round_no, {margins}, {', '.join(f'0e0 AS d{j}' for j in D)}, p{TARGET} AS pt, {_arg} AS cls, {_arg} AS orig, "
            f"0 AS steps, ({_arg}) <> {TARGET} AS active, ({_arg}) = {TARGET} AS success FROM lin UNION ALL SELECT event_id, round_no + 1, "
            + ", ".join(kept(f"m{c}", f"a{c}") for c in K) + ", " + ", ".join(kept(f"d{j}", f"b{j}") for j in D)
            + f", {kept('new', 'old')}, {kept('found', 'was')}, orig, CASE WHEN new > old AND found = {TARGET} THEN round_no + 1 ELSE {ROUNDS} END, "
            f"new > old AND found <> {TARGET}, new > old AND found = {TARGET} FROM ({best}) b WHERE rn = 1")
    return (("walk", walk), ("searched", f"SELECT event_id, {deltas}, pt, cls, orig, steps, success FROM walk WHERE NOT active OR round_no = {ROUNDS}"))


SEARCH = (*LIN, MOVES, *_search_sql())


def _recursive(*ctes, select: str) -> str:
    return with_(*ctes, select=select).replace("WITH", "WITH RECURSIVE", 1)


def search(spark, sf_dir):
    return counterfactual(features_z(spark, sf_dir), MODEL, FEATURES, len(CLASSES), TARGET, "event_id",
                          step=STEP, max_steps=ROUNDS)


@query("counterfactual", _recursive(*SEARCH, select="SELECT event_id, success, steps, orig AS original_class, cls AS final_class, "
       + r6("pt", "target_probability") + ", " + ", ".join(r6(f"d{j}", f"d_{f}") for j, f in enumerate(FEATURES)) + " FROM searched"))
def counterfactual_query(spark, sf_dir):
    out = search(spark, sf_dir)
    return rounded(out.withColumn("target_probability", F.col("probs")[TARGET]).drop("probs"))


_LONGD = " UNION ALL ".join(f"SELECT event_id, '{f}' AS feature, d{j} AS delta FROM searched" for j, f in enumerate(FEATURES))


@query("top_impacted", _recursive(*SEARCH, ("longd", _LONGD), select="SELECT event_id, CAST(rank AS INTEGER) AS rank, feature, " + r6("delta", "delta")
       + " FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(abs(delta), 9) DESC, feature) AS rank FROM longd "
       "WHERE abs(delta) > 1e-6) t WHERE rank <= 12"))
def top_impacted_query(spark, sf_dir):
    return rounded(top_impacted(search(spark, sf_dir), FEATURES, "event_id"))
