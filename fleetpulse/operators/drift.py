"""Drift between a reference table and a current one: PSI, Kolmogorov-Smirnov, mean shift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.operators.ordering import quantiles, running_totals, settled
from fleetpulse.schema import ReadingSchema, numeric_features
from fleetpulse.session import scratch_path

BUCKETS = 10
MODERATE, SEVERE = 0.1, 0.25
MIN_SIDE_ROWS = 5
KS_TERMS = 100
FLOOR = 1e-6


def common_features(reference: DataFrame, current: DataFrame, schema: ReadingSchema) -> list[str]:
    """Numeric columns of the reference that the current table also has."""
    try:
        names = numeric_features(reference, schema)
    except ValueError:
        return []
    return [c for c in names if c in current.columns]


def _melt(df: DataFrame, features: Sequence[str], is_ref: Column) -> DataFrame:
    wide = df.select(is_ref.cast("long").alias("ref_n"), *[F.col(c).cast("double").alias(c) for c in features])
    long = wide.unpivot(["ref_n"], list(features), "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("cur_n", 1 - F.col("ref_n"))


def sided(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, ref_n, cur_n) of two tables, one row per known value."""
    return _melt(reference, features, F.lit(1)).unionByName(_melt(current, features, F.lit(0)))


def sided_by(df: DataFrame, is_ref: Column, features: Sequence[str]) -> DataFrame:
    """The same from one table whose rows say which side they are on: one scan instead of two."""
    return _melt(df, features, is_ref)


def counts_by_value(long: DataFrame) -> DataFrame:
    """(feature, value, ref_n, cur_n) per distinct value: combined map-side, the only exchange of the raw values."""
    return long.groupBy("feature", "value").agg(F.sum("ref_n").alias("ref_n"), F.sum("cur_n").alias("cur_n"))


def psi_level(psi: str | Column) -> Column:
    psi = F.col(psi) if isinstance(psi, str) else psi
    return (F.when(psi.isNull(), "unknown").when(psi < MODERATE, "stable")
            .when(psi < SEVERE, "moderate").otherwise("severe"))


def _edges(counts: DataFrame, layout: str, accuracy: int | None) -> DataFrame:
    """Distinct decile edges of the reference side per feature."""
    probs = [i / BUCKETS for i in range(BUCKETS + 1)]
    if accuracy is not None:
        q = counts.where("ref_n > 0").groupBy("feature").agg(F.percentile_approx("value", probs, accuracy).alias("q"))
    else:
        q = quantiles(counts, "feature", "value", probs, layout=layout, weight="ref_n")
    return q.select(F.col("feature").alias("__f"), F.array_distinct("q").alias("edges"))


def _bin() -> Column:
    """Bin of `value` between `edges`: how many inner edges lie at or below it."""
    place = F.lit(0)
    for i in range(1, BUCKETS):
        inner = F.lit(i) < F.size("edges") - 1
        place = place + F.when(inner & (F.col("value") >= F.get("edges", F.lit(i))), 1).otherwise(0)
    return place


def _place(counts: DataFrame, edges: DataFrame) -> DataFrame:
    joined = counts.join(F.broadcast(edges), counts["feature"] == edges["__f"], "left")  # one row per column
    return joined.groupBy("feature", _bin().alias("bin")).agg(
        F.sum("ref_n").alias("ref_n"), F.sum("cur_n").alias("cur_n"), F.first(F.size("edges")).alias("n_edges"))


def side_histograms(counts: DataFrame, layout: str = "auto", accuracy: int | None = None) -> DataFrame:
    """(feature, bin, n_edges, ref_n, cur_n): both sides counted in the reference's decile bins, outer bins open."""
    return _place(counts, _edges(counts, layout, accuracy))


def _psi_of(histograms: DataFrame, more: Sequence[Column] = ()) -> DataFrame:
    folded = histograms.groupBy("feature").agg(
        F.sum("ref_n").alias("nr"), F.sum("cur_n").alias("nc"), F.first("n_edges").alias("n_edges"),
        F.collect_list(F.struct(F.col("ref_n").alias("r"), F.col("cur_n").alias("c"))).alias("bins"),  # BUCKETS at most
        *more)
    share = lambda n, total: F.greatest(n / total, F.lit(FLOOR))
    term = lambda b: ((share(b["c"], F.col("nc")) - share(b["r"], F.col("nr")))
                      * F.log(share(b["c"], F.col("nc")) / share(b["r"], F.col("nr"))))
    total = F.aggregate(F.transform("bins", term), F.lit(0.0), lambda a, x: a + x)
    value = (F.when((F.col("nr") == 0) | (F.col("nc") == 0), F.lit(None).cast("double"))
             .when(F.col("n_edges") < 3, F.lit(0.0)).otherwise(total))
    done = ("nr", "nc", "n_edges", "bins")
    return folded.withColumn("psi", value).drop(*done)


def psi(counts: DataFrame, layout: str = "auto", accuracy: int | None = None) -> DataFrame:
    """Population stability index per feature over `sided` rows or per-value counts: (feature, psi).

    Deciles of the reference, outer bins open. Fewer than three distinct edges give 0.0, a
    missing side gives NULL. The edges are one short array per feature, so their broadcast is
    bounded by the number of columns. `accuracy` switches to sketched quantiles (of `sided` rows,
    which all weigh the same): then nothing but histogram counts is exchanged.
    """
    return _psi_of(side_histograms(counts, layout, accuracy))


def side_profile(counts: DataFrame, layout: str) -> DataFrame:
    """(feature, n_ref, n_cur, ks_statistic, reference_mean, current_mean, mean_shift), one row per feature."""
    return ks_statistic(counts, layout).join(F.broadcast(mean_shift(counts)), "feature")


def _one_pass(counts: DataFrame) -> DataFrame:
    """Facts and PSI of features that fit one task each: running counts, totals and edges share one exchange
    by feature, then everything folds per bin and per feature without another read of the counts."""
    probs = F.array(*[F.lit(i / BUCKETS) for i in range(BUCKETS + 1)])
    whole = W.partitionBy("feature")
    upto = whole.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumns({
        "ref_upto": F.sum("ref_n").over(upto), "cur_upto": F.sum("cur_n").over(upto),
        "__nr": F.sum("ref_n").over(whole), "__nc": F.sum("cur_n").over(whole),
        "edges": F.array_distinct(F.percentile("value", probs, F.col("ref_n")).over(whole))})
    gap = F.abs(F.try_divide("ref_upto", "__nr") - F.try_divide("cur_upto", "__nc"))
    bins = ranked.groupBy("feature", _bin().alias("bin")).agg(
        F.sum("ref_n").alias("ref_n"), F.sum("cur_n").alias("cur_n"), F.first(F.size("edges")).alias("n_edges"),
        F.max(gap).alias("gap"), F.sum(F.col("value") * F.col("ref_n")).alias("ref_sum"),
        F.sum(F.col("value") * F.col("cur_n")).alias("cur_sum"))
    folded = _psi_of(bins, [
        F.sum("ref_n").alias("n_ref"), F.sum("cur_n").alias("n_cur"), F.max("gap").alias("ks_statistic"),
        F.try_divide(F.sum("ref_sum"), F.sum("ref_n")).alias("reference_mean"),
        F.try_divide(F.sum("cur_sum"), F.sum("cur_n")).alias("current_mean")])
    return folded.withColumn("mean_shift", F.col("current_mean") - F.col("reference_mean"))


def ks_statistic(counts: DataFrame, layout: str = "auto", **sizes) -> DataFrame:
    """Largest distance of the two distribution functions per feature, from per-value counts."""
    ranked = running_totals(counts, "feature", ["value"], {"ref_upto": "ref_n", "cur_upto": "cur_n"}, layout, **sizes)
    totals = counts.groupBy(F.col("feature").alias("__f")).agg(
        F.sum("ref_n").alias("n_ref"), F.sum("cur_n").alias("n_cur"))
    joined = ranked.join(F.broadcast(totals), ranked["feature"] == totals["__f"])  # one row per column
    gap = F.abs(F.try_divide("ref_upto", "n_ref") - F.try_divide("cur_upto", "n_cur"))
    return joined.groupBy("feature").agg(
        F.max(gap).alias("ks_statistic"), F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"))


def ks_pvalue(statistic: Column, n_ref: Column, n_cur: Column) -> Column:
    """Asymptotic two-sided p-value: the Kolmogorov series, cut where it has converged."""
    lam = statistic * F.sqrt(n_ref * n_cur / (n_ref + n_cur))
    sign = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0),
                         lambda a, k: a + sign(k) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0)))


def mean_shift(counts: DataFrame) -> DataFrame:
    """Mean of either side and their difference, from per-value counts."""
    mean = lambda n: F.try_divide(F.sum(F.col("value") * F.col(n)), F.sum(n))
    out = counts.groupBy("feature").agg(mean("ref_n").alias("reference_mean"), mean("cur_n").alias("current_mean"))
    return out.withColumn("mean_shift", F.col("current_mean") - F.col("reference_mean"))


def drift_report(
    reference: DataFrame, current: DataFrame, schema: ReadingSchema, features: Sequence[str] | None = None,
    layout: str = "auto", accuracy: int | None = None,
) -> DataFrame:
    """One row per shared numeric column, largest PSI first; columns with few values on a side are left out."""
    features = list(features or common_features(reference, current, schema))
    if not features:
        return reference.sparkSession.createDataFrame([], (
            "feature string, psi double, psi_level string, ks_statistic double, ks_pvalue double, "
            "reference_mean double, current_mean double, mean_shift double"))
    return report_of(sided(reference, current, features), len(features), layout, accuracy)


def report_of(long: DataFrame, n_features: int = 1, layout: str = "auto", accuracy: int | None = None) -> DataFrame:
    """The report from `sided` or `sided_by` rows, by way of per-value counts. In the plain layout the wide
    input is computed and exchanged once; else its counts are written once, since edges, bins, distances and means
    each read them."""
    layout = settled(layout, long, n_features)
    counts = counts_by_value(long)
    if layout == "plain" and accuracy is None:
        out = _one_pass(counts)
    else:
        path = scratch_path(counts.sparkSession, "value-counts")
        counts.write.parquet(path)
        counts = counts.sparkSession.read.parquet(path)
        shares = psi(counts if accuracy is None else long, layout, accuracy)
        out = side_profile(counts, layout).join(F.broadcast(shares), "feature")  # one row per column
    out = out.where((F.col("n_ref") >= MIN_SIDE_ROWS) & (F.col("n_cur") >= MIN_SIDE_ROWS))
    return out.select(
        "feature", "psi", psi_level("psi").alias("psi_level"), "ks_statistic",
        ks_pvalue(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur")).alias("ks_pvalue"),
        "reference_mean", "current_mean", "mean_shift").orderBy(F.desc("psi"), "feature")


def drift_summary(report: DataFrame) -> DataFrame:
    level = lambda name: F.count_if(F.col("psi_level") == name)
    counts = report.agg(F.count(F.lit(1)).alias("n"), level("severe").alias("n_severe"),
                        level("moderate").alias("n_moderate"), level("stable").alias("n_stable"))
    overall = (F.when(F.col("n") == 0, "unknown").when(F.col("n_severe") >= 3, "severe")
               .when(F.col("n_severe") + F.col("n_moderate") >= 5, "moderate").otherwise("stable"))
    return counts.select(overall.alias("overall"), "n_severe", "n_moderate", "n_stable")


def top_drifted(report: DataFrame, n: int = 15) -> DataFrame:
    return report.orderBy(F.desc("psi"), "feature").limit(n)


def save_reference(df: DataFrame, path: str) -> str:
    """Write a new version of the reference snapshot; readers of older versions are not disturbed."""
    import time

    version = f"{path}/v={int(time.time() * 1e6)}"
    df.write.mode("errorifexists").parquet(version)
    return version


def load_reference(spark, path: str) -> DataFrame:
    """The newest version of the snapshot."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    newest = max((n for n in names if n.startswith("v=")), key=lambda n: int(n[2:]))
    return spark.read.parquet(f"{path}/{newest}")
