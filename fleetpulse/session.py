"""Session defaults and shared folders."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "fleetpulse", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Where it is unset: one folder per application below the temporary folder if this machine is the whole cluster (local
    master, as in tests), else below the user's home on the default Hadoop file system, which all executors share.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named and current is None:
        spark.sparkContext.setCheckpointDir(named)
    elif current is None:
        context = spark.sparkContext
        name = f"fleetpulse-{context.applicationId}-{uuid.uuid4().hex[:6]}"
        if context.master.startswith("local") and not context.master.startswith("local-cluster"):
            named = f"file://{context._jvm.java.lang.System.getProperty('java.io.tmpdir')}/{name}"
        else:
            files = context._jvm.org.apache.hadoop.fs.FileSystem.get(context._jsc.hadoopConfiguration())
            named = f"{files.getHomeDirectory().toString()}/.sparkStaging/{name}"
        context.setCheckpointDir(named)
    return (named or current).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stable(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder once, so that later reads all see the same rows.

    Needed before partition-dependent ids are used twice and to cut the lineage of
    iterative jobs; survives the loss of executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder once and read it back, for a costly source (text) that is read several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
