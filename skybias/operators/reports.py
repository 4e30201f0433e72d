"""Availability and improvement reports, input manifests and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skybias.operators.series import hourly_mean, sensor_mean
from skybias.schemas import LEADS, RAW_FIELDS, SERIES, SERIES_LABELS


def availability_report(observations: DataFrame, start: str, end: str) -> DataFrame:
    """Sensors, their distances and the share of the hourly grid covered, per location and variable.

    ``pct_span`` counts every hour from the first to the last reading, ``pct_valid`` only hours with one.
    """
    hours = sensor_mean(hourly_mean(observations, [*SERIES, "sensor_id"]))
    wanted = F.expr(f"(unix_timestamp(timestamp'{end}') - unix_timestamp(timestamp'{start}')) div 3600 + 1")
    covered = hours.groupBy(*SERIES).agg(
        (100 * F.expr("(unix_timestamp(max(time)) - unix_timestamp(min(time))) div 3600 + 1") / wanted).alias("pct_span"),
        (100 * F.count("value") / wanted).alias("pct_valid"))
    # one row per sensor before its distance is listed
    sensors = observations.groupBy(*SERIES, "sensor_id").agg(F.min("distance_km").alias("_d"))
    sensors = sensors.groupBy(*SERIES).agg(F.count("*").alias("sensors"),
                                           F.sort_array(F.collect_list(F.round("_d", 2))).alias("distances"))
    return (sensors.join(covered, SERIES)
            .withColumns({c: F.round(c, 2) for c in ("pct_span", "pct_valid")}))


def improvement_report(run_means: DataFrame, runs: DataFrame) -> DataFrame:
    """Change in per cent of each mean score from the raw to the corrected forecast, with the number of runs."""
    keys = [*SERIES, "split"]
    metrics = "stack(5, 'NMAE', nmae, 'BIAS', bias, 'RMSE', rmse, 'De-Biased NMAE', debiased_nmae, " \
              "'Pearson Correlation', pearson) AS (metric, value)"
    long = run_means.where("run = 'Mean'").selectExpr(*keys, "type", metrics)
    both = long.groupBy(*keys, "metric").pivot("type", [SERIES_LABELS["cams"], SERIES_LABELS["corrected"]]).agg(F.first("value"))
    raw, new = F.col(SERIES_LABELS["cams"]), F.col(SERIES_LABELS["corrected"])
    change = (F.when(F.col("metric") == "BIAS", F.try_divide(100 * (F.abs(new) - F.abs(raw)), F.abs(raw)))
              .when(F.col("metric") == "Pearson Correlation", F.try_divide(100 * (new - raw), F.abs(raw)))
              .otherwise(F.try_divide(100 * (new - raw), raw)))
    counts = runs.select(*keys, "init_time").distinct().groupBy(*keys).agg(F.count("*").alias("runs"))
    return (both.select(*keys, "metric", raw.alias("cams"), new.alias("corrected"), change.alias("change_pct"))
            .join(counts, keys))


def initialization_times(bounds: DataFrame) -> DataFrame:
    """Daily stamps from ``start`` to the day after ``end`` (date columns), as yyyymmdd."""
    return bounds.select(F.explode(F.sequence("start", F.date_add("end", 1))).alias("date")).select(
        F.date_format("date", "yyyyMMdd").alias("init_date"))


def expected_forecast_inputs(bounds: DataFrame) -> DataFrame:
    """Every (init_date, variable, lead) a period needs."""
    fields = ", ".join(f"'{f}'" for f in RAW_FIELDS)
    leads = ", ".join(str(h) for h in LEADS)
    return (initialization_times(bounds)
            .selectExpr("init_date", f"explode(array({fields})) AS variable")
            .selectExpr("init_date", "variable", f"explode(array({leads})) AS lead_h")
            .withColumn("lead", F.lpad(F.col("lead_h").cast("string"), 3, "0")))


def missing_forecast_inputs(bounds: DataFrame, scanned: DataFrame) -> DataFrame:
    """The expected inputs that a scan does not have."""
    keys = ["init_date", "variable", "lead_h"]
    return expected_forecast_inputs(bounds).join(scanned.select(*keys).distinct(), keys, "left_anti")


def location_status(locations: DataFrame, outputs: DataFrame, keys: list[str] = ["location_id"]) -> DataFrame:
    """Every location with its number of output rows, whether it succeeded, and why not."""
    rows = outputs.groupBy(*keys).agg(F.count("*").alias("rows"))
    return (locations.select(*keys).distinct().join(rows, keys, "left")
            .select(*keys, F.coalesce("rows", F.lit(0)).alias("rows"), F.col("rows").isNotNull().alias("succeeded"),
                    F.when(F.col("rows").isNull(), "no data").otherwise("").alias("reason")))


def status_summary(status: DataFrame) -> DataFrame:
    """n of N succeeded."""
    return status.agg(F.count_if("succeeded").alias("succeeded"), F.count("*").alias("total"))


def field_statistics(df: DataFrame, fields: list[str]) -> DataFrame:
    """Mean and population deviation per field."""
    pairs = ", ".join(f"'{f}', {f}" for f in fields)
    return (df.selectExpr(f"stack({len(fields)}, {pairs}) AS (variable, value)")
            .groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")))
