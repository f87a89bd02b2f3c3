"""Greedy counterfactual search for many rows at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import argmax
from fleetpulse.session import stable


def counterfactual(
    df: DataFrame, score, features: Sequence[str], n_classes: int,
    target: int, key: str, movable: Sequence[str] | None = None, step: float = 0.25, max_steps: int = 60,
) -> DataFrame:
    """Move one feature by ±step per round, always the move that raises the target probability most.

    A row stops at the target class, when no move helps, or after `max_steps`. Each round
    scores the 2·d moves of all rows still active in one pass. The moves of a row are columns of
    that row and keep only the best so far: they are never rows, so nothing is exchanged or sorted.
    Only if a key repeats do its rows meet, in the first round, and go on as the one that gains most.
    `score` adds `probs` and keeps the other columns. The state is checkpointed every round,
    which keeps the plan short and survives lost executors. A model with `proba` (columns of a batch → probabilities,
    every row by itself) is searched to the end in one pass instead, whatever the number of rounds.

    Returns (key, success, steps, original_class, final_class, probs, d_<feature>…).
    """
    movable = [f for f in features if f in set(movable or features)]
    if hasattr(score, "proba"):
        return _one_pass(df, score.proba, features, movable, target, key, step, max_steps)
    zero = {f"d_{f}": F.lit(0.0) for f in features}
    first = score(df.select(key, *features)).withColumn("final_class", argmax(F.col("probs")))
    state = first.withColumns({
        **zero, "original_class": F.col("final_class"), "steps": F.lit(0),
        "success": F.col("final_class") == target, "active": F.col("final_class") != target})
    moves = [(f, v) for f in movable for v in (-step, step)]
    kept = [key, *features, *zero, "original_class", "steps"]
    done = None
    state = stable(state)
    for round_no in range(1, max_steps + 1):
        active = state.where("active")
        if active.isEmpty():
            break
        best = _best_move(active.select(*kept, F.col("probs").alias("__p")), score, moves, target)
        if round_no == 1 and not active.groupBy(key).count().where("count > 1").isEmpty():
            whole = F.struct(*[c for c in best.columns if c != key])
            best = best.groupBy(key).agg(F.max_by(whole, F.struct("__gain", -F.col("__m"))).alias("b")).select(key, "b.*")
        helps = F.col("__gain") > 0
        ahead = {name: F.col(name) + F.when(F.col("__m") == 2 * i, -step).when(F.col("__m") == 2 * i + 1, step)
                 for i, f in enumerate(movable) for name in (f, f"d_{f}")}
        back = {name: F.when(helps & F.col("__m").isin(2 * i, 2 * i + 1), ahead[name]).otherwise(F.col(name))
                for i, f in enumerate(movable) for name in (f, f"d_{f}")}
        moved = best.withColumns(back).withColumn("probs", F.when(helps, F.col("probs")).otherwise(F.col("__p")))
        moved = moved.withColumn("final_class", argmax(F.col("probs")))
        hit = helps & (F.col("final_class") == target)
        moved = moved.withColumns({
            "success": hit,
            "active": helps & ~hit,
            # an exhausted or stuck search reports the full budget
            "steps": F.when(hit, F.lit(round_no)).otherwise(F.lit(max_steps))})
        idle = state.where(~F.col("active")).select(*moved.select(*state.columns).columns)
        done = idle if done is None else done.unionByName(idle)
        state = stable(moved.select(*state.columns))
    out = state if done is None else done.unionByName(state)
    return out.select(key, "success", "steps", "original_class", "final_class", "probs", *zero)


def _best_move(df: DataFrame, score: Callable[[DataFrame], DataFrame], moves: Sequence[tuple[str, float]], target: int) -> DataFrame:
    """Add `__m`, `__gain` and `probs` of the move that raises the target most; the first of equal ones (lower feature, step down)."""
    names, best = df.columns, []
    for m, (f, v) in enumerate(moves):
        tried = score(df.withColumns({"__own": F.col(f), f: F.col(f) + v})).withColumn(
            "__new", F.col("probs")[target] - F.col("__p")[target])
        found = {"__m": F.lit(m), "__gain": F.col("__new"), "__probs": F.col("probs")}
        if best:
            wins = (F.col("__new") > F.col("__gain")) | (F.col("__gain").isNull() & F.col("__new").isNotNull())
            found = {c: F.when(wins, x).otherwise(F.col(c)) for c, x in found.items()}
        best = list(found)
        df = tried.select(*[F.col("__own").alias(c) if c == f else c for c in names], *[x.alias(c) for c, x in found.items()])
    return df.withColumnRenamed("__probs", "probs")


@dataclass
class _Walk:
    """The search over the rows of a batch, all of them a round at a time; NaN counts as the largest number, as in Spark."""

    proba: Callable[[Mapping[str, np.ndarray]], np.ndarray]
    features: Sequence[str]
    movable: Sequence[str]
    target: int
    step: float
    max_steps: int

    def start(self, x: np.ndarray) -> dict[str, np.ndarray]:
        probs = self.proba(dict(zip(self.features, x)))
        found = probs.argmax(axis=0)
        return {"x": x, "d": np.zeros_like(x), "probs": probs, "original_class": found, "final_class": found.copy(),
                "steps": np.zeros(x.shape[1], np.int64), "success": found == self.target, "active": found != self.target,
                "move": np.full(x.shape[1], -1), "gain": np.full(x.shape[1], np.nan)}

    def go(self, state: dict[str, np.ndarray], first: int, last: int) -> None:
        """Rounds `first` to `last` of the active rows, in place."""
        for round_no in range(first, last + 1):
            at = np.flatnonzero(state["active"])
            if not len(at):
                return
            columns = dict(zip(self.features, state["x"][:, at]))
            old = state["probs"][self.target, at]
            move, gain, probs = np.zeros(len(at), int), np.full(len(at), -np.inf), state["probs"][:, at]
            for m, (f, v) in enumerate((f, v) for f in self.movable for v in (-self.step, self.step)):
                tried = self.proba({**columns, f: columns[f] + v})
                new = tried[self.target] - old
                wins = (new > gain) | (np.isnan(new) & ~np.isnan(gain))
                move[wins], gain[wins], probs[:, wins] = m, new[wins], tried[:, wins]
            helps = (gain > 0) | np.isnan(gain)
            on = at[helps]
            which = np.array([self.features.index(f) for f in self.movable])[move[helps] // 2]
            by = np.where(move[helps] % 2, self.step, -self.step)
            state["x"][which, on] += by
            state["d"][which, on] += by
            state["probs"][:, on] = probs[:, helps]
            state["final_class"][on] = probs[:, helps].argmax(axis=0)
            hit = state["final_class"][at] == self.target   # never without a move: the row would not be active
            state["success"][at], state["active"][at] = hit, helps & ~hit
            # an exhausted or stuck search reports the full budget
            state["steps"][at] = np.where(hit, round_no, self.max_steps)
            state["move"][at], state["gain"][at] = move, gain


def _one_pass(df: DataFrame, proba: Callable, features: Sequence[str], movable: Sequence[str], target: int, key: str,
              step: float, max_steps: int) -> DataFrame:
    """All rounds of a row in the task that reads it. Rows that miss a feature have no class and are left out.

    Only if a key repeats is the first round taken apart: its rows meet there, one exchange.
    """
    features, deltas = list(features), [f"d_{f}" for f in features]
    walk = _Walk(proba, features, list(movable), target, step, max_steps)
    plain = {"success": pa.bool_(), "steps": pa.int32(), "original_class": pa.int32(), "final_class": pa.int32(),
             "active": pa.bool_(), "__m": pa.int32(), "__gain": pa.float64()}
    kept = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    rows = df.select(key, *[F.col(f).cast("double").alias(f) for f in features]).where(kept)
    key_type = rows.schema[key].dataType.simpleString()
    doubles = [*features, *deltas]
    schema = (f"`{key}` {key_type}, success boolean, steps int, original_class int, final_class int, active boolean, __m int, "
              "__gain double, " + ", ".join(f"`{c}` double" for c in doubles) + ", probs array<double>")

    def run(first: int, last: int):
        def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix = lambda batch, names: np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            for batch in batches:
                if not batch.num_rows:
                    continue
                state = walk.start(matrix(batch, features))
                if first > 1:   # rows that the first round has moved
                    state |= {"d": matrix(batch, deltas), **{c: batch.column(c).to_numpy(zero_copy_only=False).copy()
                                                             for c in ("original_class", "steps", "success", "active")}}
                walk.go(state, first, last)
                named = state | {"__m": state["move"], "__gain": state["gain"]}
                probs = np.ascontiguousarray(state["probs"].T)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), *[pa.array(named[c]).cast(t) for c, t in plain.items()], *map(pa.array, [*state["x"], *state["d"]]),
                     pa.FixedSizeListArray.from_arrays(pa.array(probs.ravel()), probs.shape[1]).cast(pa.list_(pa.float64()))],
                    names=[key, *plain, *doubles, "probs"])
        return batches_of

    if df.groupBy(key).count().where("count > 1").isEmpty():
        out = rows.mapInArrow(run(1, max_steps), schema)
    else:
        begun = stable(rows.mapInArrow(run(1, min(1, max_steps)), schema))
        started, whole = F.col("__m") >= 0, F.struct(*[c for c in begun.columns if c != key])
        met = begun.where(started).groupBy(key).agg(F.max_by(whole, F.struct("__gain", -F.col("__m"))).alias("b")).select(key, "b.*")
        out = met.mapInArrow(run(2, max_steps), schema).unionByName(begun.where(~started))
    return out.select(key, "success", "steps", "original_class", "final_class", "probs", *deltas)


def top_impacted(found: DataFrame, features: Sequence[str], key: str, n: int = 12) -> DataFrame:
    """The n largest changes of each row, without those below 1e-6. All from the row itself: no shuffle."""
    changes = F.array(*[F.struct(-F.abs(f"d_{f}").alias("size"), F.lit(f).alias("feature"), F.col(f"d_{f}").alias("delta"))
                        for f in features])
    kept = F.filter(changes, lambda c: F.abs(c["delta"]) > 1e-6)
    return found.select(key, F.posexplode(F.slice(F.array_sort(kept), 1, n))).select(
        key, (F.col("pos") + 1).alias("rank"), F.col("col.feature").alias("feature"), F.col("col.delta").alias("delta"))
