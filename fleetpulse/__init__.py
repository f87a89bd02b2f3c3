"""Fleet sensor diagnostics as Spark jobs: features, models, metrics, drift, alarms."""

from fleetpulse.schema import ReadingSchema

__all__ = ["ReadingSchema"]
