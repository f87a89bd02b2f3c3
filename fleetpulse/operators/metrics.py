"""Classification and regression metrics.

Scores come as (label, probs): `probs` holds the class probabilities by position in a
given class list, as Spark ML emits them. Row-wise rules (argmax, thresholds) are plain
projections on that array, without a shuffle. Curves first reduce the table to one row per
class and distinct score (combined map-side); everything else works on that or on the
K×K confusion counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import argmax, half_even, name_at, ratio
from fleetpulse.operators.ordering import quantiles, running_totals, settled

DEFAULT_THRESHOLD = 0.5


def explode_scores(df: DataFrame, classes: Sequence[str], keep: Sequence[str] = ("label",)) -> DataFrame:
    """Long form (…keep, class, idx, p): K rows per input row, no shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(i).alias("idx"), F.col("probs")[i].alias("p"))
                      for i, c in enumerate(classes)])
    return df.select(*keep, F.inline(pairs))


def score_counts(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(class, p, tp_n, n): positives and rows at each distinct score, one-vs-rest."""
    long = explode_scores(df, classes)
    return long.groupBy("class", "p").agg(
        F.count_if(F.col("label") == F.col("class")).alias("tp_n"), F.count(F.lit(1)).alias("n"))


def cumulative_counts(df: DataFrame, classes: Sequence[str], layout: str = "auto", **sizes) -> DataFrame:
    """Counts at or above each distinct score, with class totals; classes without a positive are dropped."""
    counts = score_counts(df, classes)
    layout = settled(layout, counts, len(classes))
    cum = running_totals(counts, "class", [F.desc("p")], {"tp": "tp_n", "seen": "n"}, layout, **sizes)
    totals = counts.groupBy(F.col("class").alias("__k")).agg(
        F.sum("tp_n").alias("positives"), F.sum("n").alias("rows"))
    joined = cum.join(totals, cum["class"] == totals["__k"]).drop("__k")
    return joined.where(F.col("positives") > 0)


def roc_curve(df: DataFrame, classes: Sequence[str], layout: str = "auto", **sizes) -> DataFrame:
    """(class, threshold, fpr, tpr) at each distinct score, and the origin with no threshold."""
    cum = cumulative_counts(df, classes, layout, **sizes)
    negatives = F.col("rows") - F.col("positives")
    points = cum.select("class", F.col("p").alias("threshold"),
                        F.try_divide(F.col("seen") - F.col("tp"), negatives).alias("fpr"),
                        (F.col("tp") / F.col("positives")).alias("tpr"))
    origin = points.select("class").distinct().select(
        "class", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def roc_auc(df: DataFrame, classes: Sequence[str], layout: str = "auto", **sizes) -> DataFrame:
    """Trapezoid area: each score adds its negatives times the mean of the positives before and after it."""
    cum = cumulative_counts(df, classes, layout, **sizes)
    area = (F.col("n") - F.col("tp_n")) * (F.col("tp") - F.col("tp_n") / 2.0)
    return cum.groupBy("class").agg(
        (F.try_divide(F.sum(area), F.first("positives") * (F.first("rows") - F.first("positives")))).alias("auc"))


def pr_points(cum: DataFrame) -> DataFrame:
    return cum.select("class", F.col("p").alias("threshold"), (F.col("tp") / F.col("seen")).alias("precision"),
                      (F.col("tp") / F.col("positives")).alias("recall"))


def pr_curve(df: DataFrame, classes: Sequence[str], layout: str = "auto", **sizes) -> DataFrame:
    """(class, threshold, precision, recall) at each distinct score, and the end point (1, 0)."""
    points = pr_points(cumulative_counts(df, classes, layout, **sizes))
    end = points.select("class").distinct().select(
        "class", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def pr_auc(df: DataFrame, classes: Sequence[str], layout: str = "auto", **sizes) -> DataFrame:
    cum = cumulative_counts(df, classes, layout, **sizes)
    after = F.col("tp") / F.col("seen")
    tp_before, seen_before = F.col("tp") - F.col("tp_n"), F.col("seen") - F.col("n")
    before = F.when(seen_before == 0, F.lit(1.0)).otherwise(tp_before / seen_before)
    area = F.col("tp_n") / F.col("positives") * (after + before) / 2.0
    return cum.groupBy("class").agg(F.sum(area).alias("auc"))


def calibration_table(df: DataFrame, classes: Sequence[str], bins: int = 10, layout: str = "auto") -> DataFrame:
    """Mean score and share of positives per quantile bin of each class; empty bins are left out."""
    long = explode_scores(df, classes)
    probs = [i / bins for i in range(bins + 1)]
    layout = settled(layout, long, len(classes))
    edges = quantiles(long, "class", "p", probs, layout=layout).select(F.col("class").alias("__k"), F.col("q").alias("edges"))
    joined = long.join(edges, long["class"] == edges["__k"])
    place = F.lit(0)
    for i in range(1, bins):
        place = place + F.when(F.col("p") > F.col("edges")[i], 1).otherwise(0)
    hit = F.when(F.col("label") == F.col("class"), 1.0).otherwise(0.0)
    table = joined.groupBy("class", place.alias("bin")).agg(
        F.avg("p").alias("mean_predicted"), F.avg(hit).alias("fraction_positive"))
    positive = df.groupBy(F.col("label").alias("class")).agg(F.lit(1).alias("__one"))
    return table.join(positive.select("class"), "class", "left_semi")


def expected_calibration_error(df: DataFrame, classes: Sequence[str], bins: int = 10) -> DataFrame:
    """Weighted gap of confidence and accuracy over equal-width bins of the top probability: one row."""
    top = df.select(F.array_max("probs").alias("conf"),
                    F.when(name_at(list(classes), argmax(F.col("probs"))) == F.col("label"), 1.0).otherwise(0.0).alias("hit"))
    place = F.lit(0)
    for i in range(1, bins):
        place = place + F.when(F.col("conf") >= i * (1.0 / bins), 1).otherwise(0)
    per_bin = top.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("conf").alias("conf"), F.avg("hit").alias("acc"))
    return per_bin.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def _every_class(df: DataFrame, classes: Sequence[str], name: str = "class") -> DataFrame:
    return df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], f"{name} string, idx int")


def thresholds_for_recall(df: DataFrame, classes: Sequence[str], target: float = 0.9,
                          layout: str = "auto", **sizes) -> DataFrame:
    """(class, threshold): the highest threshold that still reaches `target` recall."""
    points = pr_points(cumulative_counts(df, classes, layout, **sizes))
    best = points.groupBy("class").agg(F.coalesce(
        F.max(F.when(F.col("recall") >= target, F.col("threshold"))), F.min("threshold")).alias("threshold"))
    return _every_class(df, classes).select("class").join(best, "class", "left").select(
        "class", F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)).alias("threshold"))


def _f1(p: Column, r: Column) -> Column:
    return 2 * p * r / (p + r + 1e-12)


def best_f1_points(df: DataFrame, classes: Sequence[str], layout: str = "auto", **sizes) -> DataFrame:
    """(class, threshold, f1) with the largest F1, the lowest such threshold on ties; classes with positives only."""
    points = pr_points(cumulative_counts(df, classes, layout, **sizes)).withColumn(
        "f1", _f1(F.col("precision"), F.col("recall")))
    return points.groupBy("class").agg(
        F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def thresholds_for_f1(df: DataFrame, classes: Sequence[str], layout: str = "auto", **sizes) -> DataFrame:
    best = best_f1_points(df, classes, layout, **sizes)
    return _every_class(df, classes).select("class").join(best, "class", "left").select(
        "class", F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)).alias("threshold"))


def threshold_map(thresholds: DataFrame) -> Column:
    """class → threshold as a scalar map of one entry per class."""
    return thresholds.agg(F.map_from_entries(F.collect_list(F.struct("class", "threshold")))).scalar()


def apply_thresholds(df: DataFrame, classes: Sequence[str], thresholds: DataFrame | dict[str, float],
                     name: str = "predicted_fault") -> DataFrame:
    """Predict the class furthest above its threshold; if none reaches it, the most probable one."""
    if isinstance(thresholds, dict):
        limit = lambda c: F.lit(float(thresholds.get(c, DEFAULT_THRESHOLD)))
    else:
        df = df.withColumn("__t", threshold_map(thresholds))
        limit = lambda c: F.coalesce(F.try_element_at("__t", F.lit(c)), F.lit(DEFAULT_THRESHOLD))
    margins = F.array(*[
        F.when(F.col("probs")[i] >= limit(c), F.col("probs")[i] - limit(c)) for i, c in enumerate(classes)])
    fired = argmax(F.col("__m"))
    pick = F.when(F.array_max("__m").isNotNull(), fired).otherwise(argmax(F.col("probs")))
    return df.withColumn("__m", margins).withColumn(name, name_at(list(classes), pick)).drop("__m", "__t")


def predict_argmax(df: DataFrame, classes: Sequence[str], name: str = "predicted_fault") -> DataFrame:
    return df.withColumn(name, name_at(list(classes), argmax(F.col("probs"))))


def join_thresholds(long: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Thresholds on long-form scores, 0.5 for classes without one."""
    t = thresholds.withColumnRenamed("class", "__k")
    return (long.join(t, long["class"] == t["__k"], "left").drop("__k")
            .withColumn("threshold", F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))))


def threshold_overview(df: DataFrame, classes: Sequence[str], selected: dict[str, float] | None = None,
                       layout: str = "auto") -> DataFrame:
    """Per class: positives, best-F1 threshold, selected threshold with its precision and recall."""
    selected = selected or {}
    best = best_f1_points(df, classes, layout).select(
        "class", F.col("threshold").alias("max_f1_threshold"), F.col("f1").alias("max_f1"))
    chosen = F.create_map(*[F.lit(x) for kv in selected.items() for x in (kv[0], float(kv[1]))]) if selected else None
    pick = F.try_element_at(chosen, F.col("class")) if selected else F.lit(None).cast("double")
    frame = _every_class(df, classes).select("class").join(best, "class", "left").withColumn(
        "selected_threshold", F.coalesce(pick, "max_f1_threshold", F.lit(DEFAULT_THRESHOLD)))
    counts = score_counts(df, classes)
    joined = counts.join(F.broadcast(frame), "class")  # one row per class of the given list
    above = F.col("p") >= F.col("selected_threshold")
    sums = joined.groupBy("class").agg(
        F.sum("tp_n").alias("n_positive"),
        F.coalesce(F.sum(F.when(above, F.col("tp_n"))), F.lit(0)).alias("hit"),
        F.coalesce(F.sum(F.when(above, F.col("n"))), F.lit(0)).alias("fired"))
    some = F.col("n_positive") > 0
    share = lambda den: F.when(some, F.col("hit") / F.greatest(F.lit(1), den)).otherwise(0.0)
    return frame.join(sums, "class").select(
        "class", "n_positive", F.lit(DEFAULT_THRESHOLD).alias("default_threshold"),
        F.coalesce("max_f1_threshold", F.lit(DEFAULT_THRESHOLD)).alias("max_f1_threshold"),
        F.coalesce("max_f1", F.lit(0.0)).alias("max_f1"), "selected_threshold",
        share(F.col("fired")).alias("precision_at_selected"), share(F.col("n_positive")).alias("recall_at_selected"))


def pr_at_selected(df: DataFrame, classes: Sequence[str], selected: DataFrame, layout: str = "auto") -> DataFrame:
    """The curve point whose threshold lies nearest the selected one (the lower on ties)."""
    points = pr_points(cumulative_counts(df, classes, layout))
    t = selected.select(F.col("class").alias("__k"), F.col("threshold").alias("selected"))
    joined = points.join(t, points["class"] == t["__k"])
    nearest = F.struct(F.abs(F.col("threshold") - F.col("selected")), F.col("threshold"))
    point = F.min_by(F.struct("threshold", "precision", "recall"), nearest).alias("at")
    return joined.groupBy("class", "selected").agg(point).select("class", "selected", "at.*")


# --- from confusion counts ---------------------------------------------------------------

def confusion_counts(df: DataFrame, by: Sequence[str] = (), actual: str = "label",
                     predicted: str = "predicted_fault") -> DataFrame:
    """(…by, actual, predicted, n) for the pairs that occur."""
    return df.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, classes: Sequence[str], actual: str = "label",
                     predicted: str = "predicted_fault") -> DataFrame:
    """K×K counts in long form, zero where a pair does not occur."""
    names = F.array(*[F.lit(c) for c in classes])
    grid = _every_class(df, classes, "actual").select("actual", F.explode(names).alias("predicted"))
    return grid.join(confusion_counts(df, (), actual, predicted), ["actual", "predicted"], "left").na.fill(0, ["n"])


def class_outcomes(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(…by, class, tp, support, predicted_n) for classes seen as truth or as prediction."""
    sides = counts.select(*by, "n", F.inline(F.array(
        F.struct(F.col("actual").alias("class"), F.lit(True).alias("truth")),
        F.struct(F.col("predicted").alias("class"), F.lit(False).alias("truth")))),
        (F.col("actual") == F.col("predicted")).alias("same"))
    return sides.groupBy(*by, "class").agg(
        F.coalesce(F.sum(F.when(F.col("truth") & F.col("same"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("truth"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("truth"), F.col("n"))), F.lit(0)).alias("predicted_n"))


def class_scores(outcomes: DataFrame) -> DataFrame:
    """Precision, recall, F1 per class; empty denominators give 0."""
    return outcomes.withColumns({
        "precision": ratio(F.col("tp"), F.col("predicted_n")), "recall": ratio(F.col("tp"), F.col("support")),
        "f1": ratio(2.0 * F.col("tp"), F.col("support") + F.col("predicted_n"))})


def classification_metrics(df: DataFrame, by: Sequence[str] = (), actual: str = "label",
                           predicted: str = "predicted_fault") -> DataFrame:
    """Accuracy and macro precision, recall and F1 over the classes seen."""
    scores = class_scores(class_outcomes(confusion_counts(df, by, actual, predicted), by))
    return scores.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def per_class_f1(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    scores = class_scores(class_outcomes(confusion_counts(df))).select("class", "f1")
    return (_every_class(df, classes).select("class").join(scores, "class", "left").na.fill(0.0, ["f1"])
            .orderBy(F.desc("f1"), "class"))


def classification_report(df: DataFrame) -> DataFrame:
    """Rows per class, then the macro and the support-weighted average."""
    scores = class_scores(class_outcomes(confusion_counts(df)))
    names = ("precision", "recall", "f1")
    rows = scores.select("class", *names, "support")
    macro = scores.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(
        F.lit("macro avg").alias("class"), "*")
    weighted = scores.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names],
                          F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), "*")
    return rows.unionByName(macro).unionByName(weighted)


def metrics_at_thresholds(df: DataFrame, classes: Sequence[str],
                          thresholds: DataFrame | dict[str, float] | None = None) -> DataFrame:
    """Support, precision, recall, F1 and threshold per class with positives, four decimals."""
    if thresholds is None:
        predicted, limit = predict_argmax(df, classes), F.lit(DEFAULT_THRESHOLD)
    else:
        predicted = apply_thresholds(df, classes, thresholds)
        table = (F.create_map(*[F.lit(x) for c in classes for x in (c, float(thresholds.get(c, DEFAULT_THRESHOLD)))])
                 if isinstance(thresholds, dict) else threshold_map(thresholds))
        limit = F.coalesce(F.try_element_at(table, F.col("class")), F.lit(DEFAULT_THRESHOLD))
    scores = class_scores(class_outcomes(confusion_counts(predicted))).where(F.col("support") > 0)
    r = lambda c: half_even(c, 4)
    return scores.select("class", "support", r("precision").alias("precision"), r("recall").alias("recall"),
                         r("f1").alias("f1"), r(limit).alias("threshold"))


def macro_f1_before_after(df: DataFrame, classes: Sequence[str], thresholds) -> DataFrame:
    """Mean F1 with argmax and with thresholds: one row."""
    before = metrics_at_thresholds(df, classes).agg(F.avg("f1").alias("f1")).scalar()
    after = metrics_at_thresholds(df, classes, thresholds).agg(half_even(F.avg("f1"), 4).alias("macro_f1_after"))
    return after.select(half_even(before, 4).alias("macro_f1_before"), "macro_f1_after")


def model_comparison(predictions: DataFrame) -> DataFrame:
    """One row per model of stacked (model, label, predicted_fault) rows, best macro F1 first."""
    return classification_metrics(predictions, ["model"]).orderBy(F.desc("f1"), "model")


def best_model(comparison: DataFrame) -> DataFrame:
    """The model with the largest macro F1; the first by name on ties."""
    return comparison.orderBy(F.desc("f1"), "model").limit(1).select("model", "f1")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R² in one aggregate."""
    err = F.col(predicted) - F.col(actual)
    return df.agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (1.0 - F.try_divide(F.sum(err * err), F.count(F.lit(1)) * F.var_pop(actual))).alias("r2"))


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(predicted) - F.col(actual))
