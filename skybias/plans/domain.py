"""The chain of derived tables of one scale factor, built once per session.

Four tables are stored in the shared work folder: locations and sensors, and, as the jobs do, the processed table and the
validation table. The rest are lazy DataFrames.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession

from skybias.operators.transform import hourly_forecast, processed_table
from skybias.operators.validation import build_validation, ensemble_mean
from skybias.plans.jobs import nearby_observations, nearby_observed
from skybias.session import tune, work_path
from skybias.sources import storage
from skybias.sources.driver_tables import DriverTables

MEMBERS = 5


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.tables = spark, DriverTables(spark, sf_dir)
        self.runs: dict[str, tuple[str, DataFrame]] = {}  # folders of jobs that several queries look at

    def _dimension(self, rows: DataFrame, name: str) -> DataFrame:
        """A small table that is distilled from the readings, stored so that its many users don't read them again."""
        path = work_path(self.spark, name)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @cached_property
    def locations(self) -> DataFrame:
        return self._dimension(self.tables.locations(), "locations")

    @cached_property
    def sensors(self) -> DataFrame:
        return self._dimension(self.tables.sensor_variables(), "sensors")

    @cached_property
    def measurements(self) -> DataFrame:
        return self.tables.measurements()

    @cached_property
    def forecast(self) -> DataFrame:
        return self.tables.forecast()

    @cached_property
    def observations(self) -> DataFrame:
        return nearby_observations(self.locations, self.sensors, self.measurements)

    @cached_property
    def hourly_observed(self) -> DataFrame:
        return nearby_observed(self.locations, self.sensors, self.measurements)

    @cached_property
    def hourly_forecast(self) -> DataFrame:
        return hourly_forecast(self.forecast, self.locations)

    @property
    def processed_plan(self) -> DataFrame:
        """The transform job itself, unstored."""
        return processed_table(self.hourly_forecast, self.hourly_observed, self.locations)

    @cached_property
    def processed(self) -> DataFrame:
        """The stored output of the transform job. Everything downstream reads it several times."""
        path = work_path(self.spark, "processed")
        storage.write_processed(self.processed_plan, path)
        return storage.read_processed(self.spark, path)

    @cached_property
    def predictions(self) -> DataFrame:
        return self.tables.predictions(self.processed, MEMBERS)

    @cached_property
    def bias_hat(self) -> DataFrame:
        return ensemble_mean(self.predictions, MEMBERS)

    @property
    def validation_plan(self) -> DataFrame:
        return build_validation(self.processed, self.bias_hat)

    @cached_property
    def validation(self) -> DataFrame:
        """The stored validation table, which all score and figure tables read."""
        path = work_path(self.spark, "validation")
        rows = build_validation(self.processed, self.bias_hat, ranges=storage.VALIDATION_RANGES)
        storage.write_validation(rows, path, dealt=True)
        return storage.read_validation(self.spark, path)


@lru_cache(maxsize=8)
def _domain(spark: SparkSession, sf_dir: str) -> Domain:
    return Domain(spark, sf_dir)


def domain(spark: SparkSession, sf_dir: str) -> Domain:
    return _domain(tune(spark), sf_dir.rstrip("/"))
