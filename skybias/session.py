"""Session defaults and the shared work folder."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # every timestamp in the engine is UTC
    "spark.sql.session.timeZone": "UTC",
    # joins carry no broadcast hints: AQE picks broadcast or sort-merge from measured sizes,
    # splits skewed partitions and coalesces small ones
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # many partitions, merged up to this size: rows of keys and doubles take twenty times their compressed size when a task sorts them
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # a row of a dataset has 7 kB: Python works on a few megabytes at a time, not on 10,000 rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # what a step shuffles goes when its result is written or read, not when the driver next collects its garbage: steps hand on stored tables
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime settings the operators rely on; sizes and parallelism stay the cluster's.

    Python workers get the folder that the driver found this library in; a cluster has it installed or in --py-files.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
    env.setdefault("OMP_NUM_THREADS", "1")  # tasks fill the cores; matrix products in them must not start threads of their own
    return spark


def build_session(app: str = "skybias", master: str | None = None, **conf: str) -> SparkSession:
    """Session for scripts and tests. Extra settings are passed as ``spark__x__y=value``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared ``spark.checkpoint.dir``, or below the warehouse where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/skybias/{name}-{uuid.uuid4().hex}"


def measured(rows: DataFrame, name: str) -> DataFrame:
    """A table of statistics, stored in the shared work folder: Spark knows its size before it plans the join with the rows they belong to."""
    path = work_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
