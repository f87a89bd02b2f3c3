"""Quick rounding gives the values of `round`."""
import numpy as np
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import near_round, rounded


def test_near_round_equals_round(spark):
    rng = np.random.default_rng(11)
    values = np.concatenate([
        rng.normal(0, 1, 20000), rng.normal(0, 1e5, 20000), 10.0 ** rng.uniform(-12, 14, 20000), rng.integers(-10**7, 10**7, 20000) / 2e6,
        rng.integers(-10**6, 10**6, 20000) / 1e6, [0.0, -0.0, 5e-7, -5e-7, 1.0000005, 2.5e-6, -1e-9, np.nan, np.inf, -np.inf, 1e300, 123456.1234565]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = df.select("v", near_round("v", 6).alias("a"), F.round("v", 6).alias("b"))
    same = "a <=> b AND cast(a AS string) <=> cast(b AS string)"
    assert got.where(f"NOT ({same})").count() == 0


def test_rounded_few_columns_without_decimal_text(spark):
    few = rounded(spark.range(3).selectExpr("id", "id / 3e0 AS x"))
    assert "rint(" in few._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.x for r in few.orderBy("id").collect()] == [0.0, 0.333333, 0.666667]
