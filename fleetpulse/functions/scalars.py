"""Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def magnitude(*parts: str | Column) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    total = cols[0] * cols[0]
    for c in cols[1:]:
        total = total + c * c
    return F.sqrt(total)


def at_least(col: Column, bound: float) -> Column:
    """Lower clip that keeps missing values missing (`greatest` would not)."""
    return F.when(col < bound, F.lit(bound)).otherwise(col)


def at_most(col: Column, bound: float) -> Column:
    return F.when(col > bound, F.lit(bound)).otherwise(col)


def ratio(num: Column, den: Column) -> Column:
    """num/den with 0.0 for an empty denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body or the optimizer repeats it."""
    return F.transform(F.array(value), body)[0]


def name_at(names: list[str], index: Column) -> Column:
    """Name of a zero-based class index."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def argmax(scores: Column) -> Column:
    """Zero-based position of the first largest entry."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def half_even(col: str | Column, digits: int) -> Column:
    """Half-even rounding of the scaled binary value, as numeric Python does it (`bround` rounds the decimal
    text); the added zero turns -0.0 into 0.0."""
    scale = float(10 ** digits)
    return F.rint((F.col(col) if isinstance(col, str) else col) * scale) / scale + 0.0


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column: Spark aggregates skip only NULL."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def near_round(col: str | Column, digits: int) -> Column:
    """`round(col, digits)` of a double, value for value, mostly without the decimal text that `round` makes of each number.

    The scaled value is off by less than 1e-4 up to 1e11, so outside that distance of a tie the nearest whole number is
    certain and its quotient is the double next to it. Ties, larger values, NaN and infinities go to `round`.
    """
    value = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    size = F.abs(value) * scale
    certain = (size < 1e11) & (F.abs(size - F.floor(size) - 0.5) > 1e-4)
    return F.when(certain, F.rint(value * scale) / scale + 0.0).otherwise(F.round(value, digits))


FEW_COLUMNS = 8     # the longer expression of more columns would make a generated method too long for the JVM's compiler


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; used where results are compared across engines."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, DoubleType)}
    how = near_round if len(doubles) <= FEW_COLUMNS else F.round
    return df.select(*[how(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])
