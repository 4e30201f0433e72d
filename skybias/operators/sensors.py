"""Which sensors stand for a location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skybias.functions.physics import converted_unit, ppm_to_ugm3
from skybias.schemas import POLLUTANTS, REFERENCE_GRADE, SERIES, UNIT_NAMES
from skybias.operators.spatial import sensors_within_radius


def valid_variable(variable: str) -> str:
    if variable not in POLLUTANTS:
        raise NotImplementedError(f"unknown variable {variable!r}; known are {POLLUTANTS}")
    return variable


def has_parameter(catalogue: DataFrame, variable: str) -> DataFrame:
    """Sensors of the catalogue that measure ``variable``."""
    return catalogue.where(F.exists("parameters", lambda p: p["parameter"] == valid_variable(variable)))


def sensor_variables(catalogue: DataFrame) -> DataFrame:
    """One row per sensor and measured pollutant, nested columns flattened."""
    return (catalogue
            .select(F.col("id").alias("sensor_id"),
                    F.explode(F.array_distinct(F.col("parameters.parameter"))).alias("variable"),
                    F.col("coordinates.latitude").alias("latitude"),
                    F.col("coordinates.longitude").alias("longitude"),
                    F.col("sensorType").alias("sensor_type"),
                    F.col("firstUpdated").alias("first_updated"), F.col("lastUpdated").alias("last_updated"))
            .where(F.col("variable").isin(POLLUTANTS)))


def prefer_reference_grade(candidates: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Keep only reference-grade sensors where a group has one, else all of the group."""
    is_reference = F.col("sensor_type") == REFERENCE_GRADE
    graded = candidates.where(is_reference).select(*keys).distinct().withColumn("_graded", F.lit(True))
    return (candidates.join(graded, keys, "left")
            .where(is_reference | F.col("_graded").isNull()).drop("_graded"))


def time_range_filter(df: DataFrame, start: str, end: str, time: str = "time") -> DataFrame:
    """Open on the left, closed on the right."""
    t = F.col(time)
    return df.where((t > F.lit(start).cast("timestamp")) & (t <= F.lit(end).cast("timestamp")))


def homogeneous_units(measurements: DataFrame) -> DataFrame:
    """Readings of those sensors and variables that use exactly one, known unit."""
    unit = F.col("unit")
    one_unit = (measurements.groupBy("sensor_id", "variable")
                .agg(F.min(unit).alias("_lo"), F.max(unit).alias("_hi"), F.count_if(unit.isNull()).alias("_missing"))
                .where((F.col("_lo") == F.col("_hi")) & (F.col("_missing") == 0) & F.col("_lo").isin(list(UNIT_NAMES))))
    return measurements.join(one_unit, ["sensor_id", "variable"], "left_semi")


def unit_label(unit: Column) -> Column:
    """Written-out unit name; bytes are decoded by the cast."""
    pairs = [F.lit(x) for pair in UNIT_NAMES.items() for x in pair]
    return F.element_at(F.create_map(*pairs), unit.cast("string"))


def temporal_coverage(start: str, end: str, first: Column, last: Column) -> Column:
    """Share of the wanted hourly grid between a sensor's first and last day; -1 if it began too late."""
    start, end = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    first_day, last_day = F.date_trunc("day", first), F.date_trunc("day", last)

    def hours(a: Column, b: Column) -> Column:
        return F.floor((F.unix_timestamp(b) - F.unix_timestamp(a)) / 3600) + 1

    shared = F.greatest(hours(F.greatest(start, first_day), F.least(end, last_day)), F.lit(0))
    return (F.when((start >= first) & (end <= last), 1.0)
            .when(end < first, -1.0)
            .otherwise(F.try_divide(shared.cast("double"), hours(start, end).cast("double"))))


def rank_sensors(candidates: DataFrame, start: str, end: str) -> DataFrame:
    """Add ``coverage`` and ``rank_key`` = distance / coverage (infinite without coverage); drop -1."""
    coverage = temporal_coverage(start, end, F.col("first_updated"), F.col("last_updated"))
    return (candidates.withColumn("coverage", coverage).where("coverage <> -1")
            .withColumn("rank_key", F.coalesce(F.try_divide("distance_km", "coverage"), F.lit(float("inf")))))


def top_k_sensors(ranked: DataFrame, usable: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` ranked sensors that yield data, per location and variable.

    ``usable`` holds (sensor_id, variable). Spark cuts each task's rows to ``k`` per group before
    the shuffle, so a location with very many sensors costs no more than any other.
    """
    order = Window.partitionBy(*SERIES).orderBy("rank_key", "sensor_id")
    return (ranked.join(usable, ["sensor_id", "variable"], "left_semi")
            .withColumn("position", F.row_number().over(order)).where(F.col("position") <= k))


def candidate_sensors(locations: DataFrame, sensors: DataFrame, km: float = 100.0) -> DataFrame:
    """Radius join, then the preference for reference grade."""
    return prefer_reference_grade(sensors_within_radius(locations, sensors, km))


def select_sensors(locations: DataFrame, sensors: DataFrame, measurements: DataFrame,
                   start: str, end: str, km: float = 100.0, k: int = 5) -> DataFrame:
    """The sensors used for each location and variable: radius, grade, coverage, data, rank."""
    ranked = rank_sensors(candidate_sensors(locations, sensors, km), start, end)
    usable = homogeneous_units(time_range_filter(measurements, start, end)).select("sensor_id", "variable").distinct()
    return top_k_sensors(ranked, usable, k)


def observations_at(chosen: DataFrame, measurements: DataFrame, units: bool = True) -> DataFrame:
    """Readings of the chosen sensors, in microgram / m^3, keyed by location."""
    place = chosen.select("location_id", "sensor_id", "variable", "distance_km", "x", "y", "_x", "_y")
    readings = measurements.join(place, ["sensor_id", "variable"])
    if units:
        value = ppm_to_ugm3(F.col("value"), F.col("unit"), F.col("variable"))
        readings = readings.withColumn("value", value).withColumn("unit", converted_unit(F.col("unit"), F.col("variable")))
    return readings.select("location_id", "sensor_id", "variable", "time", "value", "distance_km",
                           "x", "y", "_x", "_y", "unit")
