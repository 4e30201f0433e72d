"""The jobs: operators put together from raw tables to stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skybias.operators import explore, features, metrics, models, reports, validation
from skybias.operators.sensors import (candidate_sensors, homogeneous_units, observations_at, select_sensors,
                                       time_range_filter)
from skybias.operators.series import hourly_mean
from skybias.operators.spatial import extract_at_locations
from skybias.operators.transform import hourly_forecast, hourly_observations, observed_series, processed_table
from skybias.schemas import SERIES
from skybias.session import work_path
from skybias.sources import storage

#: A negative reading is an error of the sensor; it must not enter a mean.
NOT_NEGATIVE = "value IS NULL OR value >= 0"


def job_observations(locations: DataFrame, sensors: DataFrame, measurements: DataFrame, start: str, end: str,
                     km: float = 100.0, k: int = 5) -> DataFrame:
    """Readings of the best ``k`` sensors of every location and variable, in microgram / m^3."""
    measurements = measurements.where(NOT_NEGATIVE)
    chosen = select_sensors(locations, sensors, measurements, start, end, km, k)
    return observations_at(chosen, time_range_filter(measurements, start, end))


def nearby_observations(locations: DataFrame, sensors: DataFrame, measurements: DataFrame) -> DataFrame:
    """Readings of all nearby sensors of the preferred grade, without a limit on their number."""
    return observations_at(candidate_sensors(locations, sensors), homogeneous_units(measurements.where(NOT_NEGATIVE)))


def nearby_hourly(locations: DataFrame, sensors: DataFrame, measurements: DataFrame) -> DataFrame:
    """Hourly readings of all nearby sensors of the preferred grade, keyed by location.

    Readings are averaged per sensor and hour before anything is joined: the raw table is scanned
    once and combined map-side, and a sensor near several locations is averaged once. The unit is
    part of the key, and conversion is linear, so both can wait until after the mean.
    """
    hourly = hourly_mean(measurements.where(NOT_NEGATIVE), ["sensor_id", "variable", "unit"])
    return observations_at(candidate_sensors(locations, sensors), homogeneous_units(hourly))


def nearby_observed(locations: DataFrame, sensors: DataFrame, measurements: DataFrame) -> DataFrame:
    """The observed series of every location from all nearby sensors of the preferred grade.

    Locations at the same coordinates have the same sensors: readings are joined, weighted, filtered and filled for one of them, and its series is
    handed to the others. So the work grows with the readings also where places and sensors get denser together.
    """
    at = F.sort_array(F.collect_list(F.struct("latitude", "longitude"))).alias("_at")
    named = locations.where("location_id IS NOT NULL")
    spots = named.groupBy("location_id").agg(at)
    members = spots.join(spots.groupBy("_at").agg(F.min("location_id").alias("_first")), "_at").select("location_id", "_first")
    firsts = members.select(F.col("_first").alias("location_id")).distinct()
    series = observed_series(nearby_hourly(named.join(firsts, "location_id", "left_semi"), sensors, measurements))
    return series.withColumnRenamed("location_id", "_first").join(members, "_first").select("location_id", "variable", "time", "observed")


def job_forecasts(locations: DataFrame, grid: DataFrame, wrap: bool = True, axes: DataFrame | None = None) -> DataFrame:
    """Wide three-hourly forecast of every location from the long grid."""
    return storage.merge_forecast_fields(extract_at_locations(locations, grid, wrap, axes))


def job_transform(forecast: DataFrame, observations: DataFrame, locations: DataFrame,
                  observations_optional: bool = False) -> DataFrame:
    return processed_table(hourly_forecast(forecast, locations), hourly_observations(observations), locations,
                           observations_optional)


def job_train(processed: DataFrame, locations: DataFrame, kind: str, path: str, n_prev: int = 24, n_future: int = 24,
              members: int = 5, min_rows: int | None = None, **params) -> DataFrame:
    """Fit, save, predict and evaluate an ensemble of every variable; returns the predictions with labels.

    The dataset is stored first, as the hours that its windows are slices of, and the model with its scalers is stored beside it: the daily job needs nothing else. The table of runs gets
    one row per variable and member, accepted or not, in place of those of an earlier run of the same path.
    """
    spark = processed.sparkSession
    storage.write_dataset(features.packed_dataset(processed, n_prev, n_future, min_rows), f"{path}/dataset")
    dataset = features.unpacked_dataset(storage.read_dataset(spark, f"{path}/dataset"), locations, n_prev, n_future)
    ensemble = models.fit_ensemble(kind, dataset, members, **params)
    models.save_members(ensemble, spark, f"{path}/model")
    storage.write_predictions(models.predict_members(ensemble, dataset, ["variable", "split"]), f"{path}/predictions", dealt=True)
    predictions = storage.read_predictions(spark, f"{path}/predictions")
    models.write_model_runs(models.evaluate(predictions), f"{path}/runs", path.rsplit("/", 1)[-1], kind, params)
    return predictions


def job_validate(processed: DataFrame, predictions: DataFrame, members: int, n_future: int = 24) -> dict[str, DataFrame]:
    """The validation table and every score table and figure table made from it."""
    bias_hat = validation.ensemble_mean(predictions, members)
    table = validation.build_validation(processed, bias_hat, n_future)
    runs = metrics.score_runs(table)
    out = {"validation": table, "incomplete_runs": validation.incomplete_runs(processed, bias_hat, n_future),
           "set_of_runs": metrics.score_runs_mean(runs), "complete_series": metrics.score_series(table)}
    for unit in ("hour", "month"):
        out[f"cycle_{unit}"] = explore.cycle_stats(table, unit)
        for by in ("type", "kind"):
            out[f"box_{unit}_{by}"] = explore.box_stats(table, unit, by)
    for agg in ("hour", "day", "month"):
        errors = explore.validation_errors(table, agg)
        histogram = explore.error_histogram(errors, [*SERIES, "data"], "value")
        out[f"histogram_{agg}"] = explore.error_cdf(histogram, [*SERIES, "data"])
        out[f"density_{agg}"] = explore.error_density(errors, [*SERIES, "data"], "value")
    return out


def _fill_unobserved(samples: DataFrame, n_prev: int, fields: list[str] = ["observed", "bias"]) -> DataFrame:
    """Past hours without a reading take the mean of the window's observed hours; windows with none drop out."""
    def fill(c: str) -> str:
        known = f"filter(slice({c}, 1, {n_prev}), v -> v IS NOT NULL)"
        mean = f"aggregate({known}, 0D, (s, v) -> s + v) / size({known})"
        return f"transform({c}, (v, i) -> if(i < {n_prev} AND v IS NULL, {mean}, v)) AS {c}"

    return (samples.where(F.expr(f"exists(slice({fields[0]}, 1, {n_prev}), v -> v IS NOT NULL)"))
            .selectExpr(*[fill(c) if c in fields else c for c in samples.columns]))


def job_daily_correction(forecast: DataFrame, observations: DataFrame, locations: DataFrame, ensemble: models.Ensemble, day: str,
                         n_prev: int = 24, n_future: int = 24, path: str | None = None) -> DataFrame:
    """Corrected forecast of one day for every location: score the window that starts at ``day`` 00:00.

    Observations from ``day`` on are not used. The ensemble, fitted or loaded, brings its variables, fields and scalers; training rows are not read.
    """
    fields = ensemble.layout.fields
    start = F.lit(day).cast("timestamp")
    margin = 24  # hours on either side, so that interpolation and differences have their neighbours
    near = F.col("time").between(start - F.expr(f"INTERVAL {n_prev + margin} HOURS"),
                                 start + F.expr(f"INTERVAL {n_future + margin} HOURS"))
    known = sorted({v for v, _ in ensemble.fitted})
    processed = job_transform(forecast.where(near), observations.where((F.col("time") < start) & F.col("variable").isin(known)), locations,
                              observations_optional=True)
    # the day's table is stored: it is read for the windows and again for the correction
    stored = work_path(forecast.sparkSession, "daily")
    storage.write_processed(processed.where(F.col("variable").isin(known)), stored)
    processed = storage.read_processed(forecast.sparkSession, stored)
    samples = validation.latest_init_forecast(features.sliding_samples(processed, n_prev, n_future, fields), day)
    samples = features.split_features_labels(_fill_unobserved(samples, n_prev, [f for f in fields if f in ("bias", "observed")]),
                                             n_prev, n_future, fields)
    samples = features.attach_attributes(samples, locations).withColumn("split", F.lit("daily"))
    bias_hat = validation.ensemble_mean(models.predict_members(ensemble, samples), ensemble.members)
    corrected = validation.correct_forecast(processed.where(F.col("time") >= start), bias_hat).select(
        *SERIES, "init_time", "horizon", "time", "forecast", "bias_hat", "corrected")
    if path:
        storage.write_corrected_forecast(corrected, path)
    return corrected


def job_explore(processed: DataFrame, locations: DataFrame, country: str) -> dict[str, DataFrame]:
    """The exploratory tables of a country."""
    rows = explore.filter_country_city(processed, locations, country)
    places = ["location_id", "city", "variable"]
    out = {"monthly_bias": explore.monthly_bias(rows), "hourly_bias": explore.hourly_bias(rows, places),
           "days_available": explore.days_available(rows, ["forecast", "observed", "bias"], places)}
    for agg in (None, "daily", "monthly"):
        name = agg or "raw"
        bias = rows.select(*SERIES, "bias") if agg is None else explore.resample_mean(rows, agg, ["bias"])
        out[f"series_{name}"] = explore.station_series(rows, agg)
        out[f"correlation_{name}"] = explore.correlation_matrix(rows, agg)
        out[f"abs_rel_bias_{name}"] = explore.abs_rel_bias(rows, agg)
        out[f"histogram_{name}"] = explore.error_cdf(explore.error_histogram(bias, SERIES, "bias"), SERIES)
    return out


def job_reports(observations: DataFrame, validation_table: DataFrame, start: str, end: str) -> dict[str, DataFrame]:
    runs = metrics.score_runs(validation_table)
    return {"availability": reports.availability_report(observations, start, end),
            "improvement": reports.improvement_report(metrics.score_runs_mean(runs), runs)}
