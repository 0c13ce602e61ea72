"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def build_session(app: str = "fieldweave", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FIELDWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Without either a temporary folder serves a ``local`` master; a cluster's executors could not see it, so there it
    is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "folder" not in _local:
        _local["folder"] = tempfile.mkdtemp(prefix="fieldweave-")
    return _local["folder"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared work folder, under this application's own folder.

    Paths are never reused, so a retry cannot read a half-written table; the application's folder can be
    removed as a whole once it has ended.
    """
    return f"{work_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of iterative plans and fixes the rows for every later reader; the files outlive
    the executors that wrote them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
