"""Versioned models: one saved pipeline per version and a small JSON index."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_SCHEMA = ("version_id string, model_name string, metric_f1 double, metric_accuracy double, "
                "n_features int, created_at string, path string")
MAX_VERSIONS = 10


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def register(spark: SparkSession, root: str, model: PipelineModel, name: str, f1: float, accuracy: float,
             n_features: int, max_versions: int = MAX_VERSIONS) -> str:
    """Save the model, add its index entry, drop what retention no longer keeps. Returns the version id."""
    now = datetime.now(timezone.utc)
    version = f"v{now:%Y%m%d-%H%M%S-%f}-{uuid.uuid4().hex[:6]}"
    path = f"{root}/models/{name.lower().replace(' ', '_')}_{version}"
    model.write().save(path)
    row = (version, name, float(f1), float(accuracy), int(n_features), f"{now:%Y-%m-%dT%H:%M:%S.%fZ}", path)
    spark.createDataFrame([row], INDEX_SCHEMA).write.mode("append").json(f"{root}/index/{version}")
    retain(spark, root, max_versions)
    return version


def entries(spark: SparkSession, root: str) -> DataFrame:
    """The index, newest first; malformed lines are skipped."""
    df = spark.read.schema(INDEX_SCHEMA).option("mode", "DROPMALFORMED").json(f"{root}/index/*")
    return df.where(F.col("version_id").isNotNull()).orderBy(F.desc("created_at"), F.desc("version_id"))


def newest_entries(index: DataFrame, n: int, tie: str = "version_id") -> DataFrame:
    """The n newest; n ≤ 0 keeps all. A top-n: no task sorts more than it must."""
    ordered = index.orderBy(F.desc("created_at"), F.desc(tie))
    return ordered if n <= 0 else ordered.limit(n)


def retain(spark: SparkSession, root: str, n: int = MAX_VERSIONS) -> None:
    """Delete index entries and models beyond the n newest."""
    if n <= 0:
        return
    for row in entries(spark, root).collect()[n:]:  # index-sized: one row per saved model
        for path in (row["path"], f"{root}/index/{row['version_id']}"):
            p, fs = _fs(spark, path)
            fs.delete(p, True)


def load(spark: SparkSession, root: str, version_id: str) -> PipelineModel | None:
    row = entries(spark, root).where(F.col("version_id") == version_id).first()
    return PipelineModel.load(row["path"]) if row else None
