"""Ordered work that stays bounded when one key holds a large part of the table.

`Window.partitionBy(key)` puts a whole key into one task. That is the best plan for
small keys (one exchange), and a dead task for a key with billions of rows. Each
operator here therefore has two layouts:

* ``plain``: an ordinary window per key. Chosen when the planner's size estimate says that
  the whole input fits one task, or when no key has more than `max_rows` rows.
* ``chunked``: rows are range-partitioned on (key, order), numbered once, and cut into
  chunks of `chunk_rows` positions. Frames that reach a few rows back or ahead see copies
  of the neighbouring rows; running totals and fills carry one summary row per chunk.
  No task ever sees more than a chunk, whatever the distribution of keys or timestamps.

Both layouts give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.session import stable

ONE_TASK_BYTES = 64 * 1024 * 1024
MAX_KEY_ROWS = 20_000_000
CHUNK_ROWS = 1_000_000
MAX_LISTED_HOT_KEYS = 1000

_POS, _CHUNK, _MID = "__pos", "__chunk", "__mid"
_ROW_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of `df`; needs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_one_task(df: DataFrame, parts: int = 1) -> bool:
    """True if one task could hold the largest key of `df`: all of it, or one of `parts` equal parts
    where the rows are known to spread evenly (an unpivot gives every column the same number of rows)."""
    limit = int(df.sparkSession.conf.get("spark.fleetpulse.oneTaskBytes", str(ONE_TASK_BYTES)))
    return plan_bytes(df) <= limit * parts


def settled(layout: str, df: DataFrame, parts: int = 1) -> str:
    """Settle "auto" once for several operators on the same evenly spread long table."""
    if layout != "auto":
        return layout
    return "plain" if fits_one_task(df, parts) else "chunked"


def hot_keys(df: DataFrame, key: str, max_rows: int = MAX_KEY_ROWS) -> DataFrame:
    """Keys with more than `max_rows` rows. Reads the key column alone; counts are combined map-side."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > max_rows)


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = _POS) -> DataFrame:
    """Add the dense zero-based position of each row in the total order `order`.

    One range exchange and a local sort; the per-partition offsets are as many rows
    as there are partitions, which bounds the broadcast and the global window.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stable(ranged.withColumn(_MID, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(_MID), _ROW_BITS).alias("__part")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    row = F.col(_MID).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        ranged.withColumn("__part", F.shiftright(F.col(_MID), _ROW_BITS))
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + row)
        .drop("__part", "__offset", _MID)
    )


def _pick(df: DataFrame, layout: str) -> str:
    if layout not in ("auto", "plain", "chunked"):
        raise ValueError(f"unknown layout: {layout}")
    if layout == "auto":
        return "plain" if fits_one_task(df) else "count"
    return layout


def _split_hot(df: DataFrame, key: str, max_rows: int):
    """(cold, hot) parts, either of which may be None. Only a short list of keys reaches the driver."""
    found = [r[0] for r in hot_keys(df, key, max_rows).select(key).limit(MAX_LISTED_HOT_KEYS + 1).collect()]
    if not found:
        return df, None
    if len(found) > MAX_LISTED_HOT_KEYS:
        return None, df
    is_hot = F.coalesce(F.col(key).isin([k for k in found if k is not None]), F.lit(False))
    if None in found:
        is_hot = is_hot | F.col(key).isNull()
    return df.where(~is_hot), df.where(is_hot)


def with_neighbours(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 0,
    ahead: int = 0,
    layout: str = "auto",
    max_rows: int = MAX_KEY_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Apply `add(df, window)`, whose frames reach at most `back` rows back and `ahead` rows ahead per key."""
    how = _pick(df, layout)
    plain = lambda part: add(part, W.partitionBy(key).orderBy(*order))
    if how == "plain":
        return plain(df)
    if how == "count":
        cold, hot = _split_hot(df, key, max_rows)
        if hot is None:
            return plain(cold)
        chunked = with_neighbours(hot, key, order, add, back, ahead, "chunked", max_rows, chunk_rows)
        return chunked if cold is None else plain(cold).unionByName(chunked)
    size = max(chunk_rows, back + ahead + 1)
    own = F.floor(F.col(_POS) / size)
    offset = F.col(_POS) % size
    homes = F.array_compact(F.array(
        own,
        F.when(offset >= size - back, own + 1) if back else F.lit(None),
        F.when(offset < ahead, own - 1) if ahead else F.lit(None),
    ))
    copies = number_rows(df, [key, *order]).withColumn(_CHUNK, F.explode(homes))
    done = add(copies, W.partitionBy(_CHUNK, key).orderBy(_POS))
    return done.where(F.col(_CHUNK) == own).drop(_POS, _CHUNK)


def positions(
    df: DataFrame, key: str, order: Sequence[str | Column], index: str = "idx", total: str = "n",
    layout: str = "auto", max_rows: int = MAX_KEY_ROWS,
) -> DataFrame:
    """Zero-based rank of each row within its key, and the key's row count."""
    how = _pick(df, layout)
    if how == "count":
        how = "plain" if hot_keys(df, key, max_rows).isEmpty() else "chunked"
    if how == "plain":
        w = W.partitionBy(key).orderBy(*order)
        return df.withColumns({
            index: (F.row_number().over(w) - 1).cast("long"),
            total: F.count(F.lit(1)).over(W.partitionBy(key)),
        })
    numbered = number_rows(df, [key, *order])
    spans = numbered.groupBy(F.col(key).alias("__key")).agg(
        F.min(_POS).alias("__first"), F.count(F.lit(1)).alias(total))
    return (
        numbered.join(spans, numbered[key].eqNullSafe(spans["__key"]))
        .withColumn(index, F.col(_POS) - F.col("__first"))
        .drop("__key", "__first", _POS)
    )


def running_totals(
    df: DataFrame, key: str, order: Sequence[str | Column], columns: dict[str, str],
    layout: str = "auto", chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Inclusive running sums per key: `columns` maps new name → summed column.

    Meant for pre-aggregated rows; keys are few (classes, features), so the chunked
    layout is used for every input that does not fit one task.
    """
    how = _pick(df, layout)
    if how == "plain":
        w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({new: F.sum(old).over(w) for new, old in columns.items()})
    numbered = number_rows(df, [key, *order]).withColumn(_CHUNK, F.floor(F.col(_POS) / chunk_rows))
    local = W.partitionBy(_CHUNK, key).orderBy(_POS).rowsBetween(W.unboundedPreceding, 0)
    per_chunk = numbered.groupBy(_CHUNK, key).agg(*[F.sum(old).alias(f"__s_{new}") for new, old in columns.items()])
    earlier = W.partitionBy(key).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carried = per_chunk.select(
        F.col(_CHUNK).alias("__c"), F.col(key).alias("__k"),
        *[F.coalesce(F.sum(f"__s_{new}").over(earlier), F.lit(0)).alias(f"__b_{new}") for new in columns])
    summed = numbered.withColumns({new: F.sum(old).over(local) for new, old in columns.items()})
    joined = summed.join(carried, (summed[_CHUNK] == carried["__c"]) & summed[key].eqNullSafe(carried["__k"]))
    out = joined.withColumns({new: F.col(new) + F.col(f"__b_{new}") for new in columns})
    return out.drop(_POS, _CHUNK, "__c", "__k", *[f"__b_{new}" for new in columns])


def fill_missing(
    df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str],
    layout: str = "auto", max_rows: int = MAX_KEY_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Last known value per key; before the first known value, that first value.

    A backward fill only ever reaches rows ahead of the first known value, so it needs
    the key's first value and no frame that looks to the end of the series.
    """
    how = _pick(df, layout)
    if how == "count":
        how = "plain" if hot_keys(df, key, max_rows).isEmpty() else "chunked"
    if how == "plain":
        w = W.partitionBy(key).orderBy(*order)
        past = w.rowsBetween(W.unboundedPreceding, 0)
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return df.withColumns({
            c: F.coalesce(c, F.last(c, True).over(past), F.first(c, True).over(whole)) for c in columns})
    numbered = number_rows(df, [key, *order]).withColumn(_CHUNK, F.floor(F.col(_POS) / chunk_rows))
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(_POS))
    per_chunk = numbered.groupBy(_CHUNK, key).agg(
        *[F.max_by(c, known(c)).alias(f"__l_{c}") for c in columns],
        *[F.min_by(c, known(c)).alias(f"__f_{c}") for c in columns])
    chunks = W.partitionBy(key).orderBy(_CHUNK)
    earlier = chunks.rowsBetween(W.unboundedPreceding, -1)
    whole = chunks.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carried = per_chunk.select(
        F.col(_CHUNK).alias("__c"), F.col(key).alias("__k"),
        *[F.last(f"__l_{c}", True).over(earlier).alias(f"__p_{c}") for c in columns],
        *[F.first(f"__f_{c}", True).over(whole).alias(f"__h_{c}") for c in columns])
    local = W.partitionBy(_CHUNK, key).orderBy(_POS).rowsBetween(W.unboundedPreceding, 0)
    here = numbered.withColumns({c: F.coalesce(c, F.last(c, True).over(local)) for c in columns})
    joined = here.join(carried, (here[_CHUNK] == carried["__c"]) & here[key].eqNullSafe(carried["__k"]))
    out = joined.withColumns({c: F.coalesce(c, f"__p_{c}", f"__h_{c}") for c in columns})
    return out.select(*df.columns)


def quantiles(
    df: DataFrame, key: str, value: str, probs: Sequence[float], name: str = "q", layout: str = "auto",
    weight: str | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per key: (key, name array<double>). `weight` counts repeated values.

    Large inputs never build one key's value map in one task: values are counted
    (combined map-side), ranked by running totals, and the two neighbours of each
    target rank are picked by a plain aggregate.
    """
    df = df.where(F.col(value).isNotNull() if weight is None else F.col(value).isNotNull() & (F.col(weight) > 0))
    times = F.lit(1) if weight is None else F.col(weight)
    how = _pick(df, layout)
    if how == "plain":
        return df.groupBy(key).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]), times).alias(name))
    counts = df.groupBy(key, value).agg(F.sum(times).alias("__n"))
    ranked = running_totals(counts, key, [value], {"__upto": "__n"}, "chunked")
    totals = counts.groupBy(F.col(key).alias("__k")).agg((F.sum("__n") - 1).alias("__last"))
    ranked = ranked.join(totals, ranked[key].eqNullSafe(totals["__k"]))
    at = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col(value)))
    picks = []
    for i, p in enumerate(probs):
        target = F.col("__last") * float(p)
        picks += [at(F.floor(target)).alias(f"__lo{i}"), at(F.ceil(target)).alias(f"__hi{i}")]
    picked = ranked.groupBy(key).agg(F.first("__last").alias("__last"), *picks)
    points = []
    for i, p in enumerate(probs):
        target = F.col("__last") * float(p)
        lo, hi = F.col(f"__lo{i}").cast("double"), F.col(f"__hi{i}").cast("double")
        points.append(lo + (target - F.floor(target)) * (hi - lo))
    return picked.select(key, F.array(*points).alias(name))
