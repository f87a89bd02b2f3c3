"""Feature contributions: sampled Shapley values, importance, top contributions, waterfall rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import let
from fleetpulse.operators.prepare import random_sample


def shapley_attribution(
    df: DataFrame, score: Callable[[DataFrame], DataFrame], features: Sequence[str], classes: Sequence[str],
    key: str, max_rows: int = 80, permutations: int = 20, background_rows: int = 50, seed: int = 0,
) -> DataFrame:
    """Monte-Carlo permutation Shapley values (Štrumbelj & Kononenko 2014) of up to `max_rows` sampled rows.

    Every (row, permutation) walks from a background row to the row itself, one feature at a
    time; `score` adds `probs` to all steps of all walks in one pass. Steps along a walk
    telescope, so the contributions of a row add up to its score minus the mean background
    score of its walks. Returns (key, class, feature, value, phi, base_value).
    """
    d = len(features)
    rows = random_sample(df.select(key, *features), key, max_rows, seed)
    back = random_sample(df.select(key, *features), key, background_rows, seed + 1)
    ranked = back.select(F.array(*features).alias("__back"), F.row_number().over(W.orderBy(key)).alias("__b"))
    size = back.agg(F.count(F.lit(1)).alias("n")).scalar()  # at most background_rows
    walks = rows.select(
        F.col(key), F.array(*features).alias("__x"), F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("__perm"))
    dice = lambda *parts: F.xxhash64(F.col(key), F.col("__perm"), F.lit(seed), *parts)
    order = F.transform(
        F.array_sort(F.array(*[F.struct(dice(F.lit(j)).alias("h"), F.lit(j).alias("j")) for j in range(d)])),
        lambda s: s["j"])
    walks = walks.withColumns({"__order": order, "__pick": (F.pmod(dice(F.lit(-1)), size) + 1).cast("int")})
    walks = walks.join(F.broadcast(ranked), F.col("__pick") == F.col("__b"))
    steps = walks.withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    known = F.slice("__order", F.lit(1), F.col("__step"))
    steps = steps.select(
        key, "__perm", "__step", "__order", "__x",
        *[F.when(F.array_contains(known, j), F.col("__x")[j]).otherwise(F.col("__back")[j]).alias(f)
          for j, f in enumerate(features)])
    scored = score(steps).select(key, "__perm", "__step", "__order", "__x", "probs")
    w = W.partitionBy(key, "__perm").orderBy("__step")
    moved = scored.withColumn("__before", F.lag("probs").over(w))
    base = moved.withColumn("__base", F.first("probs").over(w.rowsBetween(W.unboundedPreceding, 0))).where("__step > 0")
    entries = F.array(*[F.struct(F.lit(c).alias("class"), (F.col("probs")[i] - F.col("__before")[i]).alias("gain"),
                                 F.col("__base")[i].alias("base")) for i, c in enumerate(classes)])
    changed = F.get("__order", F.col("__step") - 1)
    long = base.select(key, changed.alias("__j"), F.get("__x", changed).alias("value"), F.inline(entries))
    names = F.array(*[F.lit(f) for f in features])
    return long.groupBy(key, "class", "__j").agg(
        F.first("value").alias("value"), F.avg("gain").alias("phi"), F.avg("base").alias("base_value")).select(
        key, "class", F.get(names, F.col("__j")).alias("feature"), "value", "phi", "base_value")


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature over rows and classes, largest first."""
    return (contributions.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))
            .orderBy(F.desc("importance"), "feature"))


def top_importance(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def _by_size(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy(F.desc(F.abs("phi")), "feature")


def _sized(entries: Column) -> Column:
    """Contributions of one prediction (structs of feature, value, phi), largest first."""
    return F.array_sort(F.transform(entries, lambda e: F.struct(
        (-F.abs(e["phi"])).alias("size"), e["feature"].alias("feature"), e["value"].alias("value"), e["phi"].alias("phi"))))


def top_of_row(entries: Column, k: int) -> Column:
    """`top_contributions` where all of a prediction stands in one array: no exchange."""
    return F.transform(F.slice(_sized(entries), 1, k), lambda e, i: F.struct(
        (i + 1).alias("rank"), e["feature"].alias("feature"), e["value"].alias("value"), e["phi"].alias("phi"),
        F.when(e["phi"] >= 0, "Toward").otherwise("Against").alias("direction")))


def waterfall_of_row(entries: Column, base: Column, k: int) -> Column:
    """`waterfall` where all of a prediction stands in one array: structs (position, feature, value, phi, base_value, cumulative)."""
    def bars(sized: Column) -> Column:
        size = F.size(sized) - k
        total = F.aggregate(F.slice(sized, k + 1, F.greatest(size, F.lit(0))), F.lit(0.0), lambda a, e: a + e["phi"])
        other = F.struct(F.concat(F.lit("Other ("), size.cast("string"), F.lit(")")).alias("feature"), F.lit(None).cast("double").alias("value"), total.alias("phi"))
        shown = F.transform(F.reverse(F.slice(sized, 1, k)), lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value"), e["phi"].alias("phi")))
        return F.concat(F.filter(F.array(other), lambda o: (size > 0) & (o["phi"] != 0.0)), shown)

    def placed(rows: Column) -> Column:
        upto = lambda i: F.aggregate(F.slice(rows, 1, i + 1), base, lambda a, e: a + e["phi"])
        return F.transform(rows, lambda e, i: F.struct(
            (i + 1).alias("position"), e["feature"].alias("feature"), e["value"].alias("value"), e["phi"].alias("phi"),
            base.alias("base_value"), upto(i).alias("cumulative")))

    return let(let(_sized(entries), bars), placed)


def top_contributions(contributions: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """The k largest contributions of each prediction and their direction."""
    ranked = contributions.withColumn("rank", F.row_number().over(_by_size(keys)))
    toward = F.when(F.col("phi") >= 0, "Toward").otherwise("Against")
    return ranked.where(F.col("rank") <= k).withColumn("direction", toward)


def waterfall(contributions: DataFrame, keys: Sequence[str], k: int = 8) -> DataFrame:
    """Per prediction: the rest in one bar (if not zero), then the k largest from small to large, with the running total.

    Groups are single predictions, as large as the model has features.
    """
    ranked = contributions.withColumn("rank", F.row_number().over(_by_size(keys)))
    slot = F.least(F.col("rank"), F.lit(k + 1))
    bars = ranked.groupBy(*keys, slot.alias("rank")).agg(
        F.count(F.lit(1)).alias("__n"), F.first("feature").alias("feature"), F.first("value").alias("value"),
        F.sum("phi").alias("phi"), F.first("base_value").alias("base_value"))
    rest = F.col("rank") == k + 1
    bars = bars.where(~(rest & (F.col("phi") == 0.0))).withColumns({
        "feature": F.when(rest, F.concat(F.lit("Other ("), F.col("__n").cast("string"), F.lit(")"))).otherwise(F.col("feature")),
        "value": F.when(~rest, F.col("value"))})
    w = W.partitionBy(*keys).orderBy(F.desc("rank"))
    return bars.withColumns({
        "position": F.row_number().over(w),
        "cumulative": F.col("base_value") + F.sum("phi").over(w.rowsBetween(W.unboundedPreceding, 0)),
    }).drop("rank", "__n")
