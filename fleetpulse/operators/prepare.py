"""From a feature frame to training data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.operators.ordering import fill_missing, positions
from fleetpulse.schema import ReadingSchema, numeric_features

MIN_ROWS = 10
MAX_CLASSES = 10_000

# Noise reference deviation per column.
NOISE_STD = {
    "motor_temperature": 14.0, "battery_level": 25.0, "voltage": 1.5, "current": 2.5,
    "vibration_x": 0.45, "vibration_y": 0.45, "vibration_z": 0.5,
    "acceleration_x": 0.3, "acceleration_y": 0.3, "acceleration_z": 0.6,
    "gps_accuracy": 3.0, "signal_strength": 15.0, "altitude": 25.0, "speed": 5.0,
}


def drop_unlabelled(df: DataFrame, schema: ReadingSchema) -> DataFrame:
    return df.na.drop(subset=[schema.label])


def fill_gaps(df: DataFrame, schema: ReadingSchema, columns: Sequence[str] | None = None,
              layout: str = "auto", **sizes) -> DataFrame:
    """Forward fill, then backward fill, within each system in time order."""
    cols = list(columns or numeric_features(df, schema))
    return fill_missing(df, schema.system, [schema.ts, schema.tie], cols, layout, **sizes)


def sorted_classes(df: DataFrame, label: str) -> Column:
    """Scalar array of the class names in alphabetical order; as long as there are classes."""
    return df.agg(F.array_sort(F.collect_set(F.col(label).cast("string"))).alias("classes")).scalar()


def encode_label(df: DataFrame, label: str, index: str = "label_index") -> DataFrame:
    """Add the alphabetical class index: a position in a scalar array, so no join and no shuffle of `df`."""
    place = F.array_position(sorted_classes(df, label), F.col(label).cast("string")) - 1
    return df.withColumn(index, place.cast("int"))


def hash_key(key: str, seed: int | str) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def _known(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))   # a missing key comes first, as in an ascending sort


def _class_cuts(df: DataFrame, group: Column, key: str, test_size: float, seed: int) -> DataFrame | None:
    """(class, hash and key of its ⌈test_size·n⌉-th row in hash order), one row per class; None where equal keys lie on both
    sides of a cut or there are more than `MAX_CLASSES`.

    Counts per class and hash prefix (combined map-side) tell the prefix the cut falls in; only its rows are sorted.
    """
    narrow = df.select(group.alias("__class"), _known(hash_key(key, seed)).alias("__hash"), F.col(key).alias("__key"))
    narrow = narrow.withColumn("__prefix", F.substring("__hash", 1, 4))
    counts = narrow.groupBy("__class", "__prefix").agg(F.count(F.lit(1)).alias("__n"))
    per_class = W.partitionBy("__class")
    counts = counts.withColumns({
        "__upto": F.sum("__n").over(per_class.orderBy("__prefix").rowsBetween(W.unboundedPreceding, 0)),
        "__want": F.ceil(F.sum("__n").over(per_class) * F.lit(test_size))})
    at = counts.where((F.col("__upto") >= F.col("__want")) & (F.col("__upto") - F.col("__n") < F.col("__want")))
    found = at.select("__class", "__prefix", (F.col("__want") - F.col("__upto") + F.col("__n")).alias("__left")).limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        return None
    spark = df.sparkSession
    edge = spark.createDataFrame(found, "__c string, __p string, __left long")
    near = narrow.join(F.broadcast(edge), narrow["__class"].eqNullSafe(edge["__c"]) & (narrow["__prefix"] == edge["__p"]))
    same = near.groupBy("__class", "__hash", "__key", "__left").agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__upto", F.sum("__n").over(per_class.orderBy("__hash", "__key").rowsBetween(W.unboundedPreceding, 0)))
    last = same.where((F.col("__upto") >= F.col("__left")) & (F.col("__upto") - F.col("__n") < F.col("__left")))
    cuts = last.select("__class", F.lit(True).alias("__class_cut"), F.col("__hash").alias("__cut_hash"),
                       F.col("__key").alias("__cut_key"), (F.col("__upto") > F.col("__left")).alias("__torn"))
    kept = cuts.collect()
    if any(r["__torn"] for r in kept):
        return None
    return spark.createDataFrame(kept, cuts.schema).drop("__torn")


def stratified_split(
    df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42,
    exact: bool = True, layout: str = "auto",
) -> DataFrame:
    """Add `split`: exactly ⌈test_size·n⌉ rows of every class go to 'test', chosen by a seeded hash of the key.

    Stratified if every class has two rows or more, otherwise over the whole table.
    `exact=False` cuts by the hash alone: no sort and no shuffle, class shares hold on average.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.min("n").alias("least")).first()
    if (sizes["rows"] or 0) < MIN_ROWS:
        raise ValueError(f"need at least {MIN_ROWS} rows to train, got {sizes['rows'] or 0}")
    if not exact:
        cut = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(test_size * 1_000_000)
        return df.withColumn("split", F.when(cut, "test").otherwise("train"))
    group = F.col(label).cast("string") if sizes["least"] >= 2 else F.lit("all")
    cuts = _class_cuts(df, group, key, test_size, seed) if layout == "auto" else None
    if cuts is not None:   # a comparison in the row: the wide table is neither exchanged nor sorted
        place = df.withColumns({"__group": group, "__hash": hash_key(key, seed)})
        joined = place.join(F.broadcast(cuts), place["__group"].eqNullSafe(cuts["__class"]), "left")  # one row per class
        early = F.struct(_known(F.col("__hash")), F.col(key)) <= F.struct("__cut_hash", "__cut_key")
        test = F.coalesce(F.col("__class_cut") & early, F.lit(False))
        return joined.withColumn("split", F.when(test, "test").otherwise("train")).select(*df.columns, "split")
    placed = positions(df.withColumns({"__group": group, "__hash": hash_key(key, seed)}), "__group",
                       ["__hash", key], "__i", "__n", layout)
    test = F.col("__i") < F.ceil(F.col("__n") * F.lit(test_size))
    return placed.withColumn("split", F.when(test, "test").otherwise("train")).drop("__group", "__hash", "__i", "__n")


def standardize(df: DataFrame, columns: Sequence[str], split: str | None = "split") -> DataFrame:
    """(x-mean)/deviation with population deviation fitted on the train rows; constant columns are only centred."""
    fit = df if split is None else df.where(F.col(split) == "train")
    stats = fit.agg(F.struct(*[
        fn(c).alias(f"{c}_{tag}") for c in columns for tag, fn in (("m", F.avg), ("s", F.stddev_pop))
    ]).alias("stats")).scalar()
    fitted = F.col("__stats")  # one subquery, read by every column
    scale = lambda c: F.when(fitted[f"{c}_s"] == 0, F.lit(1.0)).otherwise(fitted[f"{c}_s"])
    return df.withColumn("__stats", stats).withColumns(
        {c: (F.col(c) - fitted[f"{c}_m"]) / scale(c) for c in columns}).drop("__stats")


class _Columns(Params):
    columns = Param(Params._dummy(), "columns", "scaled columns", TypeConverters.toListString)
    means = Param(Params._dummy(), "means", "fitted means", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "fitted deviations", TypeConverters.toListFloat)


class ColumnScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage behind `standardize`. (Spark's StandardScaler divides by the sample deviation.)"""

    @keyword_only
    def __init__(self, columns=None):
        super().__init__()
        if columns is not None:
            self._set(columns=list(columns))

    def _fit(self, df: DataFrame) -> "ColumnScalerModel":
        cols = self.getOrDefault(self.columns)
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        model = ColumnScalerModel()
        model._set(columns=cols, means=[row[f"m{i}"] or 0.0 for i in range(len(cols))],
                   scales=[row[f"s{i}"] or 1.0 for i in range(len(cols))])
        return model


class ColumnScalerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        fitted = zip(self.getOrDefault(self.columns), self.getOrDefault(self.means), self.getOrDefault(self.scales))
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in fitted})


def align_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The model's columns in the model's order; those the table lacks are 0.0."""
    present = set(df.columns)
    return df.select(*keep, *[(F.col(n).cast("double") if n in present else F.lit(0.0)).alias(n) for n in names])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n/(classes·n_class) per class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    return counts.withColumn("weight", whole["rows"] / (whole["k"] * F.col("n")))


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weights as a scalar map: one entry per class, no join of the large side."""
    table = class_weights(df, label).agg(F.map_from_entries(F.collect_list(F.struct(label, "weight")))).scalar()
    return df.withColumn(name, table[F.col(label)])


def _uniform(text: Column, start: int) -> Column:
    """(0, 1) from eight hex digits of a hash."""
    return (F.conv(F.substring(text, start, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def augment_noise(df: DataFrame, scale: float, key: str | None = None, seed: int = 0) -> DataFrame:
    """Add normal noise to the sensors. With `key`, noise is a function of the row, so repeatable on any layout."""
    if scale <= 0:
        return df
    out = {}
    for i, (c, std) in enumerate(NOISE_STD.items()):
        if c not in df.columns:
            continue
        if key is None:
            z = F.randn(seed + i)
        else:
            h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{c}-{seed}")))
            z = F.sqrt(-2.0 * F.log(_uniform(h, 1))) * F.cos(2.0 * F.pi() * _uniform(h, 9))
        out[c] = F.col(c) + z * F.lit(std * scale)
    return df.withColumns(out)


def shuffle_rows(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Seeded permutation: a global sort on a hash of the key."""
    return df.withColumn("shuffle_key", hash_key(key, seed)).orderBy("shuffle_key", key)


def random_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same ones on every run; each task keeps at most n candidates."""
    return df.withColumn("__h", hash_key(key, seed)).orderBy("__h", key).limit(n).drop("__h")
