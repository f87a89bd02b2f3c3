"""The full feature frame as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetpulse.operators import features as ft
from fleetpulse.operators.ordering import with_neighbours
from fleetpulse.schema import ROLLING_SENSORS, ReadingSchema


def fused_frame(
    df: DataFrame, schema: ReadingSchema, window: int = 10,
    navigation: dict[str, float] | None = None, layout: str = "auto", **sizes,
) -> DataFrame:
    """Readings → derived, rolling and fusion columns.

    All ordered columns share one partitioning and one order, so that one exchange and
    one sort serve the lag, the 5-row and the `window`-row frames.
    """
    base = ft.vector_magnitude(df)
    sensors = [s for s in ROLLING_SENSORS if s in base.columns]

    def ordered(part, w):
        return part.withColumns({
            **ft.rate_columns(w), **ft.stability_columns(w), **ft.rolling_exprs(w, window, sensors)})

    wide = with_neighbours(base, schema.system, [schema.ts, schema.tie], ordered,
                           back=max(window, ft.STABILITY_ROWS) - 1, layout=layout, **sizes)
    return ft.fusion_indices(ft.navigation_consistency(wide, navigation, stats_from=df))
