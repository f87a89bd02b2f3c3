"""Drift of the current half of the readings against the earlier half."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.catalog.features import FUSED_CTES, FUSED_FEATURES, fused
from fleetpulse.catalog.registry import query, r6, with_
from fleetpulse.catalog.views import DRIFT_SPLIT, R, drift_sides, readings
from fleetpulse.functions.scalars import rounded
from fleetpulse.operators import drift as dr
from fleetpulse.schema import SENSORS
from fleetpulse.session import scratch_path

_PROBS = "[0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]"


def _long(source: str, names) -> tuple:
    return ("long", f"SELECT feature, value, ts < {DRIFT_SPLIT} AS is_ref FROM (SELECT ts, {', '.join(names)} FROM {source}) "
            f"UNPIVOT (value FOR feature IN ({', '.join(names)}))")


PSI = (
    ("edges", f"SELECT feature, list_sort(list_distinct(quantile_cont(value, {_PROBS}))) AS e FROM long WHERE is_ref GROUP BY 1"),
    ("bins", "SELECT long.feature, len(list_filter(e[2:len(e) - 1], lambda x: x <= value)) AS bin, min(len(e)) AS n_edges, "
     "sum(CASE WHEN is_ref THEN 1 ELSE 0 END) AS r, sum(CASE WHEN is_ref THEN 0 ELSE 1 END) AS c "
     "FROM long JOIN edges ON long.feature = edges.feature GROUP BY 1, 2"),
    ("shares", "SELECT feature, n_edges, greatest(r / sum(r) OVER w, 1e-6) AS rp, greatest(c / sum(c) OVER w, 1e-6) AS cp "
     "FROM bins WINDOW w AS (PARTITION BY feature)"),
    ("psi", "SELECT feature, CASE WHEN min(n_edges) < 3 THEN 0e0 ELSE sum((cp - rp) * ln(cp / rp)) END AS psi "
     "FROM shares GROUP BY 1"),
)
KS = (
    ("counts", "SELECT feature, value, sum(CASE WHEN is_ref THEN 1 ELSE 0 END) AS r, sum(CASE WHEN is_ref THEN 0 ELSE 1 END) AS c "
     "FROM long GROUP BY 1, 2"),
    ("cums", "SELECT feature, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER t AS nr, sum(c) OVER t AS nc FROM counts "
     "WINDOW w AS (PARTITION BY feature ORDER BY value), t AS (PARTITION BY feature)"),
    ("ks", "SELECT feature, max(abs(cr / nr - cc / nc)) AS ks_statistic, CAST(min(nr) AS BIGINT) AS n_ref, "
     "CAST(min(nc) AS BIGINT) AS n_cur FROM cums GROUP BY 1"),
    ("pvals", "SELECT *, CASE WHEN lam < 0.2e0 THEN 1e0 ELSE least(greatest(2e0 * list_sum(list_transform(range(1, 101), "
     "lambda k: CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END * exp(-2e0 * k * k * lam * lam))), 0e0), 1e0) END AS ks_pvalue "
     "FROM (SELECT *, ks_statistic * sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) AS lam FROM ks) t"),
)
MEANS = ("means", "SELECT feature, avg(CASE WHEN is_ref THEN value END) AS reference_mean, "
         "avg(CASE WHEN NOT is_ref THEN value END) AS current_mean FROM long GROUP BY 1")
LEVEL = ("CASE WHEN psi IS NULL THEN 'unknown' WHEN psi < 0.1e0 THEN 'stable' WHEN psi < 0.25e0 THEN 'moderate' "
         "ELSE 'severe' END AS psi_level")
RAW = (R, _long("readings", SENSORS))
# rolling values are rounded first: engines differ in their last bit, which moves values that sit on a bin edge
FUSED6 = ("fused6", "SELECT ts, " + ", ".join(f"round({c}, 6) AS {c}" for c in FUSED_FEATURES) + " FROM fused")
REPORT = (*FUSED_CTES, FUSED6, _long("fused6", FUSED_FEATURES), *PSI, *KS, MEANS, (
    "report", f"SELECT psi.feature, psi, {LEVEL}, ks_statistic, ks_pvalue, reference_mean, current_mean, "
    "current_mean - reference_mean AS mean_shift FROM psi JOIN pvals ON psi.feature = pvals.feature "
    "JOIN means ON psi.feature = means.feature WHERE n_ref >= 5 AND n_cur >= 5"))
_REPORT_COLS = "feature, psi_level, " + ", ".join(
    r6(c, c) for c in ("psi", "ks_statistic", "ks_pvalue", "reference_mean", "current_mean", "mean_shift"))


def _sided(spark, sf_dir):
    return dr.sided_by(readings(spark, sf_dir), F.expr(f"ts < {DRIFT_SPLIT}"), list(SENSORS))


@query("psi", with_(*RAW, *PSI, select=f"SELECT feature, {r6('psi', 'psi')} FROM psi"))
def psi(spark, sf_dir):
    return rounded(dr.psi(_sided(spark, sf_dir)))


@query("psi_level", with_(*RAW, *PSI, select=f"SELECT feature, {LEVEL} FROM psi"))
def psi_level(spark, sf_dir):
    return dr.psi(_sided(spark, sf_dir)).select("feature", dr.psi_level("psi").alias("psi_level"))


@query("ks_statistic", with_(*RAW, *KS[:3], select=f"SELECT feature, {r6('ks_statistic', 'ks_statistic')}, n_ref, n_cur FROM ks"))
def ks_statistic(spark, sf_dir):
    return rounded(dr.ks_statistic(dr.counts_by_value(_sided(spark, sf_dir))))


@query("ks_pvalue", with_(*RAW, *KS, select=f"SELECT feature, {r6('ks_pvalue', 'ks_pvalue')} FROM pvals"))
def ks_pvalue(spark, sf_dir):
    ks = dr.ks_statistic(dr.counts_by_value(_sided(spark, sf_dir)))
    return rounded(ks.select("feature", dr.ks_pvalue(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur")).alias("ks_pvalue")))


@query("mean_shift", with_(*RAW, MEANS, select="SELECT feature, " + r6("reference_mean", "reference_mean") + ", "
                           + r6("current_mean", "current_mean") + ", " + r6("current_mean - reference_mean", "mean_shift")
                           + " FROM means"))
def mean_shift(spark, sf_dir):
    return rounded(dr.mean_shift(dr.counts_by_value(_sided(spark, sf_dir))))


@query("join_drift_sides", with_(*RAW, *PSI[:2], select="SELECT feature, CAST(bin AS INTEGER) AS bin, CAST(r AS BIGINT) AS ref_n, "
                                 "CAST(c AS BIGINT) AS cur_n FROM bins"))
def join_drift_sides(spark, sf_dir):
    """Both histograms side by side, by conditional counts on a side flag."""
    return dr.side_histograms(_sided(spark, sf_dir)).select("feature", "bin", "ref_n", "cur_n")


def report(spark, sf_dir):
    wide = rounded(fused(spark, sf_dir))
    return dr.report_of(dr.sided_by(wide, F.expr(f"ts < {DRIFT_SPLIT}"), FUSED_FEATURES), len(FUSED_FEATURES))


@query("drift_report", with_(*REPORT, select=f"SELECT {_REPORT_COLS} FROM report"))
def drift_report(spark, sf_dir):
    return rounded(report(spark, sf_dir))


@query("drift_summary", with_(*REPORT, ("c", "SELECT count(*) AS n, "
       + ", ".join(f"CAST(sum(CASE WHEN psi_level = '{v}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{v}" for v in ("severe", "moderate", "stable"))
       + " FROM report"), select="SELECT CASE WHEN n = 0 THEN 'unknown' WHEN n_severe >= 3 THEN 'severe' "
       "WHEN n_severe + n_moderate >= 5 THEN 'moderate' ELSE 'stable' END AS overall, n_severe, n_moderate, n_stable FROM c"))
def drift_summary(spark, sf_dir):
    return dr.drift_summary(report(spark, sf_dir))


@query("top_drifted", with_(*REPORT, select=f"SELECT {_REPORT_COLS} FROM report ORDER BY report.psi DESC, feature LIMIT 15"))
def top_drifted(spark, sf_dir):
    return rounded(dr.top_drifted(report(spark, sf_dir), 15))


@query("reference_snapshot", with_(R, select="SELECT event_id, system_id, fault_type FROM readings"))
def reference_snapshot(spark, sf_dir):
    """First the early half becomes the reference, then it is reset to the whole table."""
    df = readings(spark, sf_dir)
    path = scratch_path(spark, "reference")
    dr.save_reference(drift_sides(df)[0], path)
    dr.save_reference(df, path)
    return dr.load_reference(spark, path).select("event_id", "system_id", "fault_type")
