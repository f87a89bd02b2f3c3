"""Counts, profiles and series on the time axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import half_even
from fleetpulse.operators.ordering import positions, quantiles, settled, with_neighbours
from fleetpulse.schema import ReadingSchema

TRACE_POINTS = 2000
TRACE_BANDS = 80
BOX_PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, largest first; missing values are not counted."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), column))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, columns and missing cells in one pass."""
    gaps = F.lit(0)
    for c in df.columns:
        gaps = gaps + F.col(c).isNull().cast("int")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.coalesce(F.sum(gaps), F.lit(0)).cast("long").alias("missing_values"))


def preview(df: DataFrame, order: Sequence[str], n: int = 15) -> DataFrame:
    return df.orderBy(*order).limit(n)


def per_system_stats(df: DataFrame, schema: ReadingSchema, digits: int = 2) -> DataFrame:
    sensors = [s for s in schema.sensors if s in df.columns]
    return df.groupBy(schema.system).agg(*[
        half_even(fn(s), digits).alias(f"{s}_{stat}")
        for s in sensors for stat, fn in (("mean", F.avg), ("std", F.stddev_samp))])


def system_fault_matrix(df: DataFrame, schema: ReadingSchema, faults: Sequence[str]) -> DataFrame:
    """Rows per system and fault. Known fault names spare the job that would look for them."""
    return (df.groupBy(schema.system).pivot(schema.label, list(faults)).agg(F.count(F.lit(1)))
            .na.fill(0))


def _long(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), name, "value")


def describe_features(df: DataFrame, columns: Sequence[str], digits: int = 3, layout: str = "auto") -> DataFrame:
    """One row per feature: count, mean, std, min, quartiles, max."""
    long = _long(df, columns, "feature")
    moments = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    layout = settled(layout, long, len(columns))
    q = quantiles(long, "feature", "value", (0.25, 0.5, 0.75), layout=layout).withColumnRenamed("feature", "__f")
    wide = moments.join(q, moments["feature"] == q["__f"], "left")
    b = lambda c: half_even(c, digits)
    return wide.select("feature", "count", b("mean").alias("mean"), b("std").alias("std"), b("min").alias("min"),
                       b(F.col("q")[0]).alias("p25"), b(F.col("q")[1]).alias("p50"), b(F.col("q")[2]).alias("p75"),
                       b("max").alias("max"))


def box_summary(df: DataFrame, key: str, value: str, layout: str = "auto") -> DataFrame:
    """What a box plot shows: quartiles, whiskers at 1.5 IQR, outlier count."""
    known = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias(value))
    q = quantiles(known, key, value, BOX_PROBS, layout=layout)
    five = q.select(F.col(key).alias("__k"), *[
        F.col("q")[i].alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    joined = known.join(five, known[key].eqNullSafe(five["__k"]))
    return joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("count"),
        *[F.first(n).alias(n) for n in ("min", "q1", "median", "q3", "max")],
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def sensor_distribution(df: DataFrame, sensors: Sequence[str], layout: str = "auto") -> DataFrame:
    long = _long(df, sensors, "sensor")
    return box_summary(long, "sensor", "value", settled(layout, long, len(sensors)))


def feature_by_class(df: DataFrame, schema: ReadingSchema, feature: str, layout: str = "auto") -> DataFrame:
    return box_summary(df, schema.label, feature, layout)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum; empty bins are kept."""
    known = df.where(F.col(value).isNotNull())
    span = known.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).scalar()
    known, span = known.withColumn("__span", span), F.col("__span")
    width = (span["hi"] - span["lo"]) / bins
    place = F.when(width > 0, F.least(F.floor((F.col(value) - span["lo"]) / width), F.lit(bins - 1))).otherwise(0)
    filled = known.select(place.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    limits = df.where(F.col(value).isNotNull()).agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), limits.alias("__span"))
    return every.join(filled, "bin", "left").select(
        "bin", (span["lo"] + F.col("bin") * width).alias("lower"),
        (span["lo"] + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("n", F.lit(0)).alias("count"))


def distinct_counts(df: DataFrame, schema: ReadingSchema, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(count(F.col(schema.system)).alias("systems"), count(F.col(schema.label)).alias("classes"))


def distinct_systems(df: DataFrame, schema: ReadingSchema) -> DataFrame:
    return df.select(schema.system).distinct().orderBy(schema.system)


def prediction_summary(records: DataFrame) -> DataFrame:
    """Counts per fault and per risk, and the total with the mean confidence, in one pass."""
    sets = [["predicted_fault"], ["risk_level"], []]   # a missing fault or risk is no class of its own
    grouped = records.groupingSets(sets, "predicted_fault", "risk_level").agg(
        F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("mean_confidence"))
    kind = F.when(F.col("__g") == 1, "fault").when(F.col("__g") == 2, "risk").otherwise("total")
    grouped = grouped.where((F.col("__g") == 3) | F.coalesce("predicted_fault", "risk_level").isNotNull())
    return grouped.select(
        kind.alias("kind"), F.coalesce("predicted_fault", "risk_level", F.lit("all")).alias("name"), "count",
        F.when(F.col("__g") == 3, F.col("mean_confidence")).alias("mean_confidence"))


def anomaly_breakdown(df: DataFrame, label: str, flag: str) -> DataFrame:
    return (df.groupBy(label).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col(flag)).alias("anomalies"))
        .withColumn("anomaly_rate", F.col("anomalies") / F.col("samples")).orderBy(F.desc("anomaly_rate"), label))


def prediction_accuracy(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("correct")).alias("correct"))


def home_summary(raw: DataFrame, n_features: int, comparison: DataFrame) -> DataFrame:
    """Rows, features, models and best model. Both sides are one row each, joined as scalars."""
    models = comparison.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.min_by("model", F.struct(-F.col("f1"), F.col("model"))).alias("best")).alias("m")).scalar()
    return raw.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(n_features).cast("long").alias("fused_features"),
        models["n"].alias("n_models"), models["best"].alias("best_model"))


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def rul_label(df: DataFrame, schema: ReadingSchema, layout: str = "auto") -> DataFrame:
    """Readings left until the end of the system's series (of the table if there is no system column)."""
    if schema.system not in df.columns:
        whole = df.withColumn("__all", F.lit(0))
        out = positions(whole, "__all", [schema.ts, schema.tie], "__i", "__n", layout).drop("__all")
    else:
        out = positions(df, schema.system, [schema.ts, schema.tie], "__i", "__n", layout)
    return out.withColumn("rul", F.col("__n") - 1 - F.col("__i")).drop("__i", "__n")


def rul_cycle_label(df: DataFrame, unit: str, cycle: str, healthy_cutoff: int = 50) -> DataFrame:
    """Cycles left per unit and the label derived from them. The last cycle comes from an
    aggregate joined back, so that no unit has to fit one task."""
    last = df.groupBy(F.col(unit).alias("__unit")).agg(F.max(cycle).alias("__last"))
    out = df.join(last, df[unit] == last["__unit"]).withColumn("rul", F.col("__last") - F.col(cycle))
    failing = F.when(F.col("rul") <= healthy_cutoff, "Motor Overheating").otherwise("Normal")
    return out.withColumn("fault_type", failing).drop("__unit", "__last")


def fault_windows(
    df: DataFrame, schema: ReadingSchema, limit: int | None = TRACE_BANDS, layout: str = "auto", **sizes,
) -> DataFrame:
    """Unbroken runs of one non-Normal label per system, at most the `limit` longest of each system.

    A run is found from its two border rows only: the second window sees borders, not readings.
    """
    order = [schema.ts, schema.tie]
    label = F.col(schema.label)

    def borders(part, w):
        before, after = F.lag(label).over(w), F.lead(label).over(w)
        first, last = F.lag(schema.tie).over(w).isNull(), F.lead(schema.tie).over(w).isNull()
        return part.withColumns({
            "__start": first | ~before.eqNullSafe(label), "__end": last | ~after.eqNullSafe(label)})

    def close(part, w):
        end = F.when(F.col("__end"), F.col(schema.ts)).otherwise(F.lead(schema.ts).over(w))
        return part.withColumn("end_ts", end)

    slim = df.select(schema.system, *order, schema.label)
    marked = with_neighbours(slim, schema.system, order, borders, back=1, ahead=1, layout=layout, **sizes)
    edges = marked.where("__start or __end")
    runs = with_neighbours(edges, schema.system, order, close, ahead=1, layout=layout, **sizes)
    found = runs.where(F.col("__start") & (label != "Normal")).select(
        schema.system, F.col(schema.ts).alias("start_ts"), "end_ts", schema.label, F.col(schema.tie).alias("__tie"))
    if limit is None:
        return found.drop("__tie")
    length = (micros("end_ts") - micros("start_ts")).alias("__length")
    ranked = positions(found.withColumn("__length", length), schema.system,
                       [F.desc("__length"), F.col("start_ts"), F.col("__tie")], "__i", "__n", layout)
    return ranked.where(F.col("__i") < limit).drop("__length", "__i", "__n", "__tie")


def downsample_trace(
    df: DataFrame, schema: ReadingSchema, column: str, max_points: int = TRACE_POINTS, layout: str = "auto",
) -> DataFrame:
    """Every (n div max_points)-th reading of each system with more than `max_points` readings."""
    placed = positions(df.select(schema.system, schema.ts, schema.tie, column), schema.system,
                       [schema.ts, schema.tie], "__i", "__n", layout)
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / max_points))
    return placed.where(F.col("__i") % step == 0).drop("__i", "__n")


def system_series(df: DataFrame, schema: ReadingSchema, column: str) -> DataFrame:
    return df.select(schema.system, schema.ts, schema.tie, column).orderBy(schema.system, schema.ts, schema.tie)
