"""The chain from sensors and forecast files to the processed table, in jobs that can be run again.

A job's folder holds ``manifest`` and ``data``, both by batch (one batch a run). A run takes the places that no manifest names, writes their data
and then their statuses; a place without data has a status too. Rows count only if the manifest of their batch names their place, so what a lost run
left behind is never read, and the next run writes over it. One run writes to a folder at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skybias.operators import reports
from skybias.operators.sensors import observations_at, select_sensors, time_range_filter, valid_variable
from skybias.plans.jobs import NOT_NEGATIVE, job_forecasts, job_transform
from skybias.schemas import POLLUTANTS, RAW_FIELDS, SERIES
from skybias.sources import storage

PLACES = ["location_id"]


def manifest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, job, rows, succeeded, reason, batch) of all places that the runs of a job have dealt with."""
    schema = ", ".join(f"{k} STRING" for k in keys) + ", rows LONG, succeeded BOOLEAN, reason STRING, job STRING"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/manifest/batch=0")
    return spark.read.schema(f"{schema}, batch INT").parquet(f"{path}/manifest")


def committed(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The rows of a job's folder that its manifest names."""
    done = manifest(spark, path, keys).where("succeeded")
    batches = [r.batch for r in done.select("batch").distinct().collect()]  # one a run
    if not batches:
        return spark.createDataFrame([], schema)
    rows = (spark.read.schema(schema).option("basePath", f"{path}/data")
            .parquet(*[f"{path}/data/batch={b}" for b in sorted(batches)]))
    return rows.join(done.select(*keys, "batch"), [*keys, "batch"], "left_semi").select(*schema.names)


def run_missing(job: str, path: str, todo: DataFrame, keys: list[str], produce: Callable[[DataFrame], DataFrame],
                write: Callable[[DataFrame, str], None], retry: bool = False) -> DataFrame:
    """Do what the manifest of ``path`` lacks of ``todo`` (keys); returns all rows of the job.

    ``produce`` takes the missing places. ``retry`` also takes those that had no data before.
    """
    spark = todo.sparkSession
    known = manifest(spark, path, keys)
    batch = known.agg(F.coalesce(F.max("batch"), F.lit(0)) + 1).first()[0]
    work = f"{path}/todo/batch={batch}"
    wanted = storage.only_missing(todo.select(*keys).distinct(), known.where("succeeded") if retry else known, keys)
    wanted.write.mode("overwrite").parquet(work)
    wanted = spark.read.schema(wanted.schema).parquet(work)
    rows = produce(wanted)
    if not wanted.isEmpty():
        target = f"{path}/data/batch={batch}"
        write(rows, target)
        written = spark.read.schema(rows.schema).parquet(target)
        status = reports.location_status(wanted, written, keys).withColumn("job", F.lit(job))
        status.write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")
    return committed(spark, path, rows.schema, keys)


def latest_status(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """One row per place: the status of the last run that dealt with it."""
    last = F.max_by(F.struct("job", "rows", "succeeded", "reason"), "batch").alias("s")
    return manifest(spark, path, keys).groupBy(*keys).agg(last).select(*keys, "s.*")


def run_observations(path: str, locations: DataFrame, sensors: DataFrame, measurements: DataFrame, start: str, end: str,
                     variables: list[str] = POLLUTANTS, km: float = 100.0, k: int = 5, retry: bool = False) -> DataFrame:
    """Readings of the best ``k`` sensors of every location and variable, stored by variable and country. An unknown variable is an error."""
    names = F.array(*[F.lit(valid_variable(v)) for v in variables])
    readings = measurements.where(NOT_NEGATIVE)

    def produce(wanted: DataFrame) -> DataFrame:
        places = locations.join(wanted.select("location_id").distinct(), "location_id", "left_semi")
        chosen = select_sensors(places, sensors, readings, start, end, km, k).join(wanted, SERIES, "left_semi")
        return observations_at(chosen, time_range_filter(readings, start, end))

    return run_missing("observations", path, locations.select("location_id", F.explode(names).alias("variable")), SERIES, produce,
                       lambda rows, target: storage.write_observations(rows, locations, target, start, end), retry)


def run_forecasts(path: str, locations: DataFrame, files: str, start: str, end: str, wrap: bool = True, retry: bool = False) -> DataFrame:
    """Wide forecast of every location from the grid files of ``start`` .. ``end``, stored by country.

    ``statistics`` beside it holds the mean and deviation of every field, ``missing`` the inputs of the period that the files lack.
    """
    spark = locations.sparkSession
    first, last = (F.lit(day).cast("date") for day in (start, end))
    bounds = locations.limit(1).select(first.alias("start"), last.alias("end"))
    # the forecast of the day after the end has the hours that follow it
    grid = storage.scan_forecast_files(spark, files).where(
        F.col("init_date").between(F.date_format(first, "yyyyMMdd"), F.date_format(F.date_add(last, 1), "yyyyMMdd")))

    def produce(wanted: DataFrame) -> DataFrame:
        return job_forecasts(locations.join(wanted, PLACES, "left_semi"), grid, wrap)

    def write(rows: DataFrame, target: str) -> None:
        storage.write_forecast(rows, locations, target, start, end)
        reports.missing_forecast_inputs(bounds, grid).write.mode("overwrite").parquet(f"{path}/missing")

    before = manifest(spark, path, PLACES).count()
    rows = run_missing("forecasts", path, locations, PLACES, produce, write, retry)
    if manifest(spark, path, PLACES).count() > before:
        reports.field_statistics(rows, RAW_FIELDS).write.mode("overwrite").parquet(f"{path}/statistics")
    return rows


def run_transform(path: str, observations: DataFrame, forecast: DataFrame, locations: DataFrame, todo: DataFrame, retry: bool = False) -> DataFrame:
    """The processed table of the places in ``todo`` (location_id, variable)."""
    def produce(wanted: DataFrame) -> DataFrame:
        own = forecast.join(wanted.select("location_id").distinct(), "location_id", "left_semi")
        return job_transform(own, observations.join(wanted, SERIES, "left_semi"), locations)

    return run_missing("transform", path, todo, SERIES, produce, storage.write_processed, retry)


def run_chain(path: str, locations: DataFrame, sensors: DataFrame, measurements: DataFrame, files: str, start: str, end: str,
              variables: list[str] = POLLUTANTS, retry: bool = False) -> DataFrame:
    """Observations, forecasts and the processed table below ``path``; a second run does only what the first one lacks.

    All places of ``locations`` and ``variables`` get a status; the transform finds no data where one of its inputs has none.
    """
    observations = run_observations(f"{path}/observations", locations, sensors, measurements, start, end, variables, retry=retry)
    forecast = run_forecasts(f"{path}/forecasts", locations, files, start, end, retry=retry)
    todo = manifest(locations.sparkSession, f"{path}/observations", SERIES).select(*SERIES).distinct()
    return run_transform(f"{path}/processed", observations, forecast, locations, todo, retry)
