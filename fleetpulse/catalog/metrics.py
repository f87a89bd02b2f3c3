"""Curves, thresholds, confusion, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.catalog.explore import TOP
from fleetpulse.catalog.features import FUSED_FEATURES
from fleetpulse.catalog.registry import query, r6, with_
from fleetpulse.catalog.views import CLASSES, READINGS, R, S, readings, scored
from fleetpulse.functions.scalars import rounded
from fleetpulse.operators import explore as ex
from fleetpulse.operators import metrics as mt

CUM = (
    ("counts", "SELECT class, p, sum(CASE WHEN label = class THEN 1 ELSE 0 END) AS tp_n, count(*) AS n FROM scored GROUP BY 1, 2"),
    ("cums", "SELECT class, p, tp_n, n, CAST(sum(tp_n) OVER w AS DOUBLE) AS tp, CAST(sum(n) OVER w AS DOUBLE) AS seen, "
     "CAST(sum(tp_n) OVER t AS DOUBLE) AS pos, CAST(sum(n) OVER t AS DOUBLE) AS total FROM counts "
     "WINDOW w AS (PARTITION BY class ORDER BY p DESC), t AS (PARTITION BY class)"),
)
PR = (*S, *CUM, ("pr", "SELECT class, p AS threshold, tp / seen AS precision, tp / pos AS recall FROM cums"))
_NULLD = "CAST(NULL AS DOUBLE)"


@query("roc_curve", with_(*S, *CUM, select="SELECT class, p AS threshold, " + r6("(seen - tp) / (total - pos)", "fpr") + ", "
       + r6("tp / pos", "tpr") + f" FROM cums UNION ALL SELECT DISTINCT class, {_NULLD}, 0e0, 0e0 FROM cums"))
def roc_curve(spark, sf_dir):
    return rounded(mt.roc_curve(scored(spark, sf_dir), CLASSES))


@query("roc_auc", with_(*S, *CUM, ("pts", "SELECT class, (seen - tp) / (total - pos) AS x, tp / pos AS y FROM cums"),
       ("steps", "SELECT class, (x - coalesce(lag(x) OVER w, 0e0)) * (y + coalesce(lag(y) OVER w, 0e0)) / 2e0 AS a FROM pts "
        "WINDOW w AS (PARTITION BY class ORDER BY x, y)"), select=f"SELECT class, {r6('sum(a)', 'auc')} FROM steps GROUP BY 1"))
def roc_auc(spark, sf_dir):
    return rounded(mt.roc_auc(scored(spark, sf_dir), CLASSES))


@query("pr_curve", with_(*PR, select="SELECT class, threshold, " + r6("precision", "precision") + ", " + r6("recall", "recall")
       + f" FROM pr UNION ALL SELECT DISTINCT class, {_NULLD}, 1e0, 0e0 FROM pr"))
def pr_curve(spark, sf_dir):
    return rounded(mt.pr_curve(scored(spark, sf_dir), CLASSES))


@query("pr_auc", with_(*PR, ("steps", "SELECT class, (recall - coalesce(lag(recall) OVER w, 0e0)) * (precision + "
       "coalesce(lag(precision) OVER w, 1e0)) / 2e0 AS a FROM pr WINDOW w AS (PARTITION BY class ORDER BY threshold DESC)"),
       select=f"SELECT class, {r6('sum(a)', 'auc')} FROM steps GROUP BY 1"))
def pr_auc(spark, sf_dir):
    return rounded(mt.pr_auc(scored(spark, sf_dir), CLASSES))


@query("calibration_table", with_(*S, ("edges", "SELECT class, quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) "
       "AS e FROM scored GROUP BY 1"), select="SELECT scored.class, CAST(len(list_filter(e[2:10], lambda x: x < p)) AS INTEGER) AS bin, "
       + r6("avg(p)", "mean_predicted") + ", " + r6("avg(CASE WHEN label = scored.class THEN 1e0 ELSE 0e0 END)", "fraction_positive")
       + " FROM scored JOIN edges ON scored.class = edges.class GROUP BY 1, 2"))
def calibration_table(spark, sf_dir):
    return rounded(mt.calibration_table(scored(spark, sf_dir), CLASSES))


_BIN = " + ".join(f"CASE WHEN confidence >= {i * 0.1!r}e0 THEN 1 ELSE 0 END" for i in range(1, 10))


@query("expected_calibration_error", with_(*S, TOP, ("b", f"SELECT {_BIN} AS bin, count(*) AS n, avg(confidence) AS c, "
       "avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) AS a FROM top GROUP BY 1"),
       select=f"SELECT {r6('sum(n * abs(c - a)) / sum(n)', 'ece')} FROM b"))
def expected_calibration_error(spark, sf_dir):
    return rounded(mt.expected_calibration_error(scored(spark, sf_dir), CLASSES))


RECALL_T = ("recall_t", "SELECT class, coalesce(max(CASE WHEN recall >= 0.9e0 THEN threshold END), min(threshold)) AS threshold "
            "FROM pr GROUP BY 1")
F1 = ("f1s", "SELECT *, 2e0 * precision * recall / (precision + recall + 1e-12) AS f1 FROM pr")
F1_T = ("f1_t", "SELECT class, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY f1 DESC, threshold) "
        "AS rn FROM f1s) t WHERE rn = 1")


@query("threshold_target_recall", with_(*PR, RECALL_T, select="SELECT * FROM recall_t"))
def threshold_target_recall(spark, sf_dir):
    return mt.thresholds_for_recall(scored(spark, sf_dir), CLASSES, 0.9)


@query("threshold_max_f1", with_(*PR, F1, F1_T, select="SELECT class, threshold FROM f1_t"))
def threshold_max_f1(spark, sf_dir):
    return mt.thresholds_for_f1(scored(spark, sf_dir), CLASSES)


def _decide(name: str, source: str) -> tuple:
    return (name, "SELECT row_id, label, class AS predicted_fault FROM (SELECT s.*, row_number() OVER (PARTITION BY row_id ORDER BY "
            f"p >= coalesce(t.threshold, 0.5e0) DESC, CASE WHEN p >= coalesce(t.threshold, 0.5e0) THEN p - coalesce(t.threshold, 0.5e0) "
            f"ELSE p END DESC, s.idx) AS rn FROM scored s LEFT JOIN {source} t ON s.class = t.class) d WHERE rn = 1")


@query("apply_thresholds", with_(*PR, RECALL_T, _decide("decided", "recall_t"), select="SELECT * FROM decided"))
def apply_thresholds(spark, sf_dir):
    df = scored(spark, sf_dir)
    return mt.apply_thresholds(df, CLASSES, mt.thresholds_for_recall(df, CLASSES)).drop("probs")


@query("join_thresholds", with_(*PR, RECALL_T, select="SELECT row_id, s.class, p, threshold FROM scored s JOIN recall_t t ON s.class = t.class"))
def join_thresholds(spark, sf_dir):
    df = scored(spark, sf_dir)
    long = mt.explode_scores(df, CLASSES, ["row_id"]).drop("idx")
    return mt.join_thresholds(long, mt.thresholds_for_recall(df, CLASSES))


SELECTED = {"Normal": 0.35, "GPS Fault": 0.3}
_SEL = "CASE class " + " ".join(f"WHEN '{c}' THEN {v}e0" for c, v in SELECTED.items()) + " ELSE threshold END"


@query("threshold_overview", with_(*PR, F1, F1_T, ("sel", f"SELECT class, threshold, f1, {_SEL} AS s FROM f1_t"), select=(
    "SELECT scored.class, CAST(sum(CASE WHEN label = scored.class THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, "
    "0.5e0 AS default_threshold, min(threshold) AS max_f1_threshold, " + r6("min(f1)", "max_f1") + ", min(s) AS selected_threshold, "
    + r6("sum(CASE WHEN label = scored.class AND p >= s THEN 1e0 ELSE 0e0 END) / greatest(1, sum(CASE WHEN p >= s THEN 1 ELSE 0 END))",
         "precision_at_selected") + ", "
    + r6("sum(CASE WHEN label = scored.class AND p >= s THEN 1e0 ELSE 0e0 END) / greatest(1, sum(CASE WHEN label = scored.class "
         "THEN 1 ELSE 0 END))", "recall_at_selected") + " FROM scored JOIN sel ON scored.class = sel.class GROUP BY 1")))
def threshold_overview(spark, sf_dir):
    return rounded(mt.threshold_overview(scored(spark, sf_dir), CLASSES, SELECTED))


def _outcomes(name: str, source: str) -> tuple:
    return (name, "SELECT class, CAST(sum(CASE WHEN label = class AND predicted_fault = class THEN 1 ELSE 0 END) AS DOUBLE) AS tp, "
            "CAST(sum(CASE WHEN label = class THEN 1 ELSE 0 END) AS BIGINT) AS support, "
            "CAST(sum(CASE WHEN predicted_fault = class THEN 1 ELSE 0 END) AS DOUBLE) AS fired "
            f"FROM {source} CROSS JOIN (SELECT DISTINCT class FROM scored) k GROUP BY 1")


_P = "CASE WHEN fired = 0 THEN 0e0 ELSE tp / fired END"
_R = "CASE WHEN support = 0 THEN 0e0 ELSE tp / support END"
_F = "CASE WHEN support + fired = 0 THEN 0e0 ELSE 2e0 * tp / (support + fired) END"


def _even(e: str, n: str) -> str:
    return f"(round_even({e}, 4) + 0e0) AS {n}"


@query("metrics_at_thresholds", with_(*PR, RECALL_T, _decide("decided", "recall_t"), _outcomes("o_after", "decided"), TOP,
       _outcomes("o_before", "top"), select=" UNION ALL ".join(
           f"SELECT '{stage}' AS stage, o.class, support, {_even(_P, 'precision')}, {_even(_R, 'recall')}, {_even(_F, 'f1')}, "
           f"{_even(t, 'threshold')} FROM o_{stage} o JOIN recall_t t ON o.class = t.class"
           for stage, t in (("before", "0.5e0"), ("after", "t.threshold")))))
def metrics_at_thresholds(spark, sf_dir):
    df = scored(spark, sf_dir)
    before = mt.metrics_at_thresholds(df, CLASSES).select(F.lit("before").alias("stage"), "*")
    after = mt.metrics_at_thresholds(df, CLASSES, mt.thresholds_for_recall(df, CLASSES)).select(F.lit("after").alias("stage"), "*")
    return before.unionByName(after)


@query("macro_f1_before_after", with_(*PR, RECALL_T, _decide("decided", "recall_t"), _outcomes("o_after", "decided"), TOP,
       _outcomes("o_before", "top"), select=f"SELECT (SELECT {_even(f'avg(round_even({_F}, 4))', 'x')} FROM o_before) AS macro_f1_before, "
       f"(SELECT {_even(f'avg(round_even({_F}, 4))', 'x')} FROM o_after) AS macro_f1_after"))
def macro_f1_before_after(spark, sf_dir):
    df = scored(spark, sf_dir)
    return mt.macro_f1_before_after(df, CLASSES, mt.thresholds_for_recall(df, CLASSES))


@query("pr_at_selected", with_(*PR, F1, F1_T, select="SELECT class, selected, threshold, " + r6("precision", "precision") + ", "
       + r6("recall", "recall") + " FROM (SELECT pr.*, 0.37e0 AS selected, row_number() OVER (PARTITION BY pr.class ORDER BY "
       "abs(pr.threshold - 0.37e0), pr.threshold) AS rn FROM pr) t WHERE rn = 1"))
def pr_at_selected(spark, sf_dir):
    df = scored(spark, sf_dir)
    selected = spark.createDataFrame([(c, 0.37) for c in CLASSES], "class string, threshold double")
    return rounded(mt.pr_at_selected(df, CLASSES, selected))


def predictions(spark, sf_dir):
    return mt.predict_argmax(scored(spark, sf_dir), CLASSES)


_GRID = ("grid", "SELECT a.class AS actual, b.class AS predicted FROM (SELECT DISTINCT class FROM scored) a "
         "CROSS JOIN (SELECT DISTINCT class FROM scored) b")


@query("confusion_matrix", with_(*S, TOP, _GRID, select="SELECT actual, predicted, count(row_id) AS n FROM grid LEFT JOIN top "
                                 "ON label = actual AND predicted_fault = predicted GROUP BY 1, 2"))
def confusion_matrix(spark, sf_dir):
    return mt.confusion_matrix(predictions(spark, sf_dir), CLASSES)


OUT = (*S, TOP, _outcomes("o", "top"))
_MACRO = (f"{r6('sum(tp) / sum(support)', 'accuracy')}, {r6(f'avg({_P})', 'precision')}, {r6(f'avg({_R})', 'recall')}, "
          f"{r6(f'avg({_F})', 'f1')}")


@query("classification_metrics", with_(*OUT, select=f"SELECT {_MACRO} FROM o"))
def classification_metrics(spark, sf_dir):
    return rounded(mt.classification_metrics(predictions(spark, sf_dir)))


@query("per_class_f1", with_(*OUT, select=f"SELECT class, {r6(_F, 'f1')} FROM o"))
def per_class_f1(spark, sf_dir):
    return rounded(mt.per_class_f1(predictions(spark, sf_dir), CLASSES))


@query("classification_report", with_(*OUT, ("s", f"SELECT class, {_P} AS p, {_R} AS r, {_F} AS f, support FROM o"), select=(
    "SELECT class, " + r6("p", "precision") + ", " + r6("r", "recall") + ", " + r6("f", "f1") + ", support FROM s UNION ALL "
    "SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM s UNION ALL "
    "SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), "
    "round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s")))
def classification_report(spark, sf_dir):
    return rounded(mt.classification_report(predictions(spark, sf_dir)))


def three_models(spark, sf_dir):
    """Stacked predictions of three decision rules on the same scores."""
    df = scored(spark, sf_dir)
    stacked = [("argmax", mt.predict_argmax(df, CLASSES)),
               ("recall", mt.apply_thresholds(df, CLASSES, mt.thresholds_for_recall(df, CLASSES))),
               ("best_f1", mt.apply_thresholds(df, CLASSES, mt.thresholds_for_f1(df, CLASSES)))]
    frames = [d.select(F.lit(m).alias("model"), "label", "predicted_fault") for m, d in stacked]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


COMPARE = (*PR, RECALL_T, F1, F1_T, TOP, _decide("d_recall", "recall_t"), _decide("d_f1", "f1_t"),
           _outcomes("o_argmax", "top"), _outcomes("o_recall", "d_recall"), _outcomes("o_best_f1", "d_f1"),
           ("comparison", " UNION ALL ".join(f"SELECT '{m}' AS model, {_MACRO} FROM o_{m}" for m in ("argmax", "recall", "best_f1"))))


@query("model_comparison", with_(*COMPARE, select="SELECT * FROM comparison"))
def model_comparison(spark, sf_dir):
    return rounded(mt.model_comparison(three_models(spark, sf_dir)))


@query("best_model", with_(*COMPARE, select="SELECT model, f1 FROM comparison ORDER BY f1 DESC, model LIMIT 1"))
def best_model(spark, sf_dir):
    return rounded(mt.best_model(mt.model_comparison(three_models(spark, sf_dir))))


@query("home_summary", with_(*COMPARE, select="SELECT (SELECT count(*) FROM readings) AS rows, CAST(61 AS BIGINT) AS fused_features, "
       "CAST(3 AS BIGINT) AS n_models, (SELECT model FROM comparison ORDER BY f1 DESC, model LIMIT 1) AS best_model"))
def home_summary(spark, sf_dir):
    return ex.home_summary(readings(spark, sf_dir), len(FUSED_FEATURES), mt.model_comparison(three_models(spark, sf_dir)))


GUESS = "3e1 + (motor_temperature - 6e1) / 2e0 + speed / 1e1"
RUL = ("rul", "SELECT event_id, CAST(row_number() OVER (PARTITION BY system_id ORDER BY ts DESC, event_id DESC) - 1 AS DOUBLE) AS rul, "
       f"{GUESS} AS guess FROM readings")


def rul_predictions(spark, sf_dir):
    """Remaining readings and a fixed guess at them."""
    df = ex.rul_label(readings(spark, sf_dir), READINGS)
    return df.select("event_id", F.col("rul").cast("double").alias("rul"), F.expr(GUESS).alias("guess"))


@query("regression_metrics", with_(R, RUL, select="SELECT " + r6("avg(abs(guess - rul))", "mae") + ", "
       + r6("sqrt(avg((guess - rul) * (guess - rul)))", "rmse") + ", "
       + r6("1e0 - sum((guess - rul) * (guess - rul)) / (count(*) * var_pop(rul))", "r2") + " FROM rul"))
def regression_metrics(spark, sf_dir):
    return rounded(mt.regression_metrics(rul_predictions(spark, sf_dir), "rul", "guess"))


@query("rul_residuals", with_(R, RUL, select="SELECT event_id, rul, " + r6("guess", "guess") + ", " + r6("guess - rul", "residual") + " FROM rul"))
def rul_residuals(spark, sf_dir):
    return rounded(mt.residuals(rul_predictions(spark, sf_dir), "rul", "guess"))
