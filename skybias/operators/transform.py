"""From readings and forecasts to the processed table with the forecast error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skybias.functions.physics import air_density, mixing_ratio_to_ugm3, surface_pressure
from skybias.functions.timeparts import local_hour
from skybias.operators.series import (differentiate_accumulated, distance_weighted_mean, drop_incomplete,
                                      hourly_mean, interpolate_gaps, iqr_outlier_filter, negative_to_null,
                                      upsample_linear)
from skybias.schemas import ACCUMULATED, FIELD_RENAMES, FIELDS, POLLUTANTS, RAW_FIELDS


def observed_series(hourly: DataFrame, rate: float = 20, max_gap_hours: int = 12) -> DataFrame:
    """Hourly readings of the sensors of a location to (location_id, variable, time, observed): weighted,
    filtered and gap-filled."""
    return interpolate_gaps(iqr_outlier_filter(distance_weighted_mean(hourly), rate=rate), max_gap_hours=max_gap_hours)


def hourly_observations(observations: DataFrame, rate: float = 20, max_gap_hours: int = 12) -> DataFrame:
    """The observed series from raw readings at locations."""
    hourly = hourly_mean(observations, ["location_id", "variable", "sensor_id", "distance_km"])
    return observed_series(hourly, rate, max_gap_hours)


def rename_forecast_fields(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(FIELD_RENAMES)


def convert_concentrations(df: DataFrame, locations: DataFrame, density_fields: list[str] = POLLUTANTS) -> DataFrame:
    """Pollutant fields to microgram / m^3: times air density for ``density_fields``, times 1e9 for all."""
    rows = df.join(locations.select("location_id", "elevation"), "location_id")
    density = air_density(surface_pressure(F.col("msl"), F.col("t2m"), F.col("elevation")), F.col("t2m"))
    rows = rows.withColumn("_density", density)
    ones = F.lit(1.0)
    return (rows.withColumns({p: mixing_ratio_to_ugm3(F.col(p), F.col("_density") if p in density_fields else ones)
                              for p in POLLUTANTS})
            .drop("_density", "elevation"))


def hourly_forecast(forecast: DataFrame, locations: DataFrame, reset_aware: bool = False,
                    density_fields: list[str] = POLLUTANTS) -> DataFrame:
    """(location_id, time, <field>_forecast ...): hourly, converted, de-accumulated."""
    rows = rename_forecast_fields(forecast.select("location_id", "time", *RAW_FIELDS))
    rows = convert_concentrations(upsample_linear(rows, FIELDS), locations, density_fields)
    rows = differentiate_accumulated(rows, ACCUMULATED, reset_aware=reset_aware)
    return rows.withColumnsRenamed({f: f"{f}_forecast" for f in FIELDS})


def merge_forecast_observed(forecast: DataFrame, observed: DataFrame, how: str = "inner") -> DataFrame:
    """Hourly forecast and observation side by side. ``outer`` keeps hours that have only one of them."""
    return forecast.join(observed, ["location_id", "time"], {"inner": "inner", "outer": "full"}[how])


def forecast_of_variable() -> Column:
    """The forecast column of the row's own pollutant."""
    cases = " ".join(f"WHEN '{p}' THEN {p}_forecast" for p in POLLUTANTS)
    return F.expr(f"CASE variable {cases} END")


def add_bias(df: DataFrame) -> DataFrame:
    """``bias`` = forecast - observed."""
    return df.withColumn("bias", F.col("forecast") - F.col("observed"))


def processed_table(forecast: DataFrame, observed: DataFrame, locations: DataFrame,
                    observations_optional: bool = False) -> DataFrame:
    """The hourly table models and reports read: sixteen fields, forecast, observed, bias, local hour.

    ``observations_optional`` keeps forecast hours without an observation (their bias is null), as
    needed when correcting a day that has not been observed yet.
    """
    zones = locations.select("location_id", "timezone")
    if observations_optional:
        variables = F.explode(F.array(*[F.lit(p) for p in POLLUTANTS]))
        merged = (forecast.withColumn("variable", variables)
                  .join(observed, ["location_id", "variable", "time"], "left"))
    else:
        merged = merge_forecast_observed(forecast, observed)
    merged = negative_to_null(merged.withColumn("forecast", forecast_of_variable()))
    merged = merged.join(zones, "location_id").withColumn("local_time_hour", local_hour(F.col("time"), F.col("timezone")))
    merged = merged.drop("timezone")
    return add_bias(merged if observations_optional else drop_incomplete(merged))
