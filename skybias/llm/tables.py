"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skybias.session import work_path


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from where the driver found it; a cluster has it installed or in --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
    # texts can be long: batches of fewer rows than the default keep the memory of workers and of the JVM's buffers small
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    # what a query shuffles goes with it, not when the driver next collects its garbage: steps hand on stored tables
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a table in the shared folder and read back: lineage ends there and survives lost executors."""
    path = work_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, name: str, key: str) -> DataFrame:
    """The rows, stored in buckets of ``key`` in the shared folder: a join by it moves the other side only.

    ``df`` is grouped by the key already, so a task writes whole buckets.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, f"llm-{name}")
    title = f"llm_{path.rsplit('-', 1)[-1]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(title)
    return spark.table(title)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
