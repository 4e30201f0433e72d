"""Queries on readings, forecasts and the processed table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skybias.functions import physics
from skybias.functions.geo import haversine_km
from skybias.functions.timeparts import local_hour, time_features
from skybias.operators import explore, series, spatial, transform
from skybias.operators.sensors import (candidate_sensors, homogeneous_units, prefer_reference_grade, rank_sensors,
                                       select_sensors, temporal_coverage, time_range_filter)
from skybias.operators.validation import persistence_24h
from skybias.plans.check_tables import haversine, to_ugm3, upsample
from skybias.plans.check_tables import local_hour as sql_local_hour, location_id as sql_location_id
from skybias.plans.registry import query
from skybias.schemas import ACCUMULATED, FIELDS, SERIES
from skybias.sources.driver_tables import PERIOD, home_location_id

START, END = PERIOD
COARSE = {"msl": 3, "dsrp": 3, "uvb": 3, "msl_forecast": 3, "dsrp_forecast": 3, "uvb_forecast": 3}
ALL_FORECAST = " ".join(f"{f}_forecast" for f in FIELDS)
COLUMNS = ALL_FORECAST.replace(" ", ", ")

# --- sensor choice ------------------------------------------------------------------------------


@query("sensors_within_radius", tables="pairs", doubles="distance_km",
       sql="SELECT location_id, sensor_id, variable, distance_km FROM pairs")
def _(d):
    return spatial.sensors_within_radius(d.locations, d.sensors).select(
        "location_id", "sensor_id", "variable", "distance_km")


@query("haversine_km", tables="sensors locations", doubles="distance_km", sql=f"""
       SELECT s.sensor_id, l.location_id, {haversine('l.latitude', 'l.longitude', 's.latitude', 's.longitude')} AS distance_km
       FROM sensors s JOIN locations l ON l.location_id = {sql_location_id('(s.sensor_id // 30)')}""")
def _(d):
    s = d.tables.sensors().withColumn("location_id", home_location_id(F.col("sensor_id")))
    home = d.locations.select("location_id", F.col("latitude").alias("_y"), F.col("longitude").alias("_x"))
    distance = haversine_km(F.col("_y"), F.col("_x"), F.col("latitude"), F.col("longitude"))
    return s.join(home, "location_id").select("sensor_id", "location_id", distance.alias("distance_km"))


@query("prefer_reference_grade", tables="candidates",
       sql="SELECT location_id, sensor_id, variable, sensor_type FROM candidates")
def _(d):
    pairs = spatial.sensors_within_radius(d.locations, d.sensors)
    return prefer_reference_grade(pairs).select("location_id", "sensor_id", "variable", "sensor_type")


@query("time_range_filter", tables="measurements", doubles="value", sql="""
       SELECT sensor_id, variable, time, value FROM measurements
       WHERE time > TIMESTAMP '2024-01-05' AND time <= TIMESTAMP '2024-01-20'""")
def _(d):
    return time_range_filter(d.measurements, "2024-01-05", "2024-01-20").select("sensor_id", "variable", "time", "value")


@query("homogeneous_units", tables="one_unit", doubles="value",
       sql="SELECT sensor_id, variable, time, value, unit FROM one_unit")
def _(d):
    return homogeneous_units(d.measurements).select("sensor_id", "variable", "time", "value", "unit")


COVERAGE_SQL = f"""
    CASE WHEN TIMESTAMP '{START}' >= first_updated AND TIMESTAMP '{END}' <= last_updated THEN 1.0::DOUBLE
         WHEN TIMESTAMP '{END}' < first_updated THEN -1.0::DOUBLE
         ELSE len(list_filter(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 HOUR),
                    lambda h: h >= date_trunc('day', first_updated) AND h <= date_trunc('day', last_updated)))::DOUBLE
              / len(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 HOUR)) END"""


@query("temporal_coverage", tables="sensors", doubles="coverage", sql=f"SELECT sensor_id, {COVERAGE_SQL} AS coverage FROM sensors")
def _(d):
    return d.tables.sensors().select(
        "sensor_id", temporal_coverage(START, END, F.col("first_updated"), F.col("last_updated")).alias("coverage"))


RANKED_SQL = f"""
    SELECT *, coalesce(distance_km / nullif(coverage, 0), 'inf'::DOUBLE) AS rank_key
    FROM (SELECT *, {COVERAGE_SQL} AS coverage FROM candidates) WHERE coverage <> -1"""


@query("rank_sensors", tables="candidates", doubles="distance_km coverage rank_key",
       sql=f"SELECT location_id, variable, sensor_id, distance_km, coverage, rank_key FROM ({RANKED_SQL})")
def _(d):
    return rank_sensors(candidate_sensors(d.locations, d.sensors), START, END).select(
        "location_id", "variable", "sensor_id", "distance_km", "coverage", "rank_key")


@query("top_k_sensors", tables="candidates measurements one_unit", doubles="rank_key", sql=f"""
       SELECT location_id, variable, sensor_id, rank_key, position FROM (
         SELECT *, row_number() OVER (PARTITION BY location_id, variable ORDER BY rank_key, sensor_id) AS position
         FROM ({RANKED_SQL}) r WHERE (sensor_id, variable) IN (
           SELECT (sensor_id, variable) FROM one_unit WHERE time > TIMESTAMP '{START}' AND time <= TIMESTAMP '{END}'))
       WHERE position <= 5""")
def _(d):
    return select_sensors(d.locations, d.sensors, d.measurements, START, END).select(
        "location_id", "variable", "sensor_id", "rank_key", "position")


@query("ppm_to_ugm3", tables="measurements", doubles="value", sql=f"""
       SELECT sensor_id, variable, time, {to_ugm3('value', 'unit', 'variable')} AS value,
              CASE WHEN variable IN ('o3', 'no2') THEN 'µg/m³' ELSE unit END AS unit FROM measurements""")
def _(d):
    value, unit, variable = F.col("value"), F.col("unit"), F.col("variable")
    return d.measurements.select("sensor_id", "variable", "time", physics.ppm_to_ugm3(value, unit, variable).alias("value"),
                                 physics.converted_unit(unit, variable).alias("unit"))


# --- observed series ----------------------------------------------------------------------------


@query("hourly_mean", tables="sensor_hours", doubles="distance_km value", sql="SELECT * FROM sensor_hours")
def _(d):
    return series.hourly_mean(d.observations, ["location_id", "variable", "sensor_id", "distance_km"])


def _weighted(d):
    return series.distance_weighted_mean(series.hourly_mean(d.observations, ["location_id", "variable", "sensor_id", "distance_km"]))


@query("distance_weighted_mean", tables="weighted", doubles="observed", sql="SELECT * FROM weighted")
def _(d):
    return _weighted(d)


@query("sensor_mean", tables="sensor_hours", doubles="value",
       sql="SELECT location_id, variable, time, avg(value) AS value FROM sensor_hours GROUP BY ALL")
def _(d):
    return series.sensor_mean(series.hourly_mean(d.observations, [*SERIES, "sensor_id", "distance_km"]))


@query("quartile_bounds", tables="bounds", doubles="q1 q3 iqr threshold", sql="SELECT * FROM bounds")
def _(d):
    return series.quartile_bounds(_weighted(d))


@query("iqr_outlier_filter", tables="measurements", doubles="value", sql="""
       SELECT m.sensor_id, m.variable, m.time, m.value FROM measurements m
       JOIN (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
             FROM measurements GROUP BY variable) b ON b.variable = m.variable AND m.value < b.q3 + 2 * (b.q3 - b.q1)""")
def _(d):
    # raw readings have outliers at a rate of 2, the smoothed series has none at 20
    rows = d.measurements.select("sensor_id", "variable", "time", "value")
    return series.iqr_outlier_filter(rows, ["variable"], "value", rate=2)


@query("interpolate_gaps", tables="observed", doubles="observed", sql="SELECT * FROM observed")
def _(d):
    return d.hourly_observed


@query("negative_to_null", tables="processed", doubles="bias", sql="""
       SELECT location_id, variable, time, CASE WHEN bias >= 0 THEN bias END AS bias FROM processed""")
def _(d):
    return series.negative_to_null(d.processed.select(*SERIES, "time", "bias"), "bias")


@query("drop_incomplete", tables="observed hourly_forecast", doubles=f"observed {ALL_FORECAST}", coarse=COARSE, sql=f"""
       SELECT location_id, time, variable, observed, {COLUMNS} FROM observed JOIN hourly_forecast USING (location_id, time)
       WHERE observed IS NOT NULL AND {' AND '.join(f"{c} IS NOT NULL" for c in ALL_FORECAST.split())}""")
def _(d):
    outer = transform.merge_forecast_observed(d.hourly_forecast, d.hourly_observed, "outer")
    return series.drop_incomplete(outer.select("location_id", "time", "variable", "observed", *ALL_FORECAST.split()))


# --- forecast series ----------------------------------------------------------------------------


@query("upsample_linear", tables="renamed", doubles=" ".join(FIELDS), coarse=COARSE,
       sql=upsample("renamed", "location_id", FIELDS))
def _(d):
    return series.upsample_linear(transform.rename_forecast_fields(d.forecast), FIELDS)


@query("surface_pressure", tables="forecast locations", doubles="surface_pressure", coarse={"surface_pressure": 3}, sql="""
       SELECT location_id, time, msl * pow(1 - 0.0065 * elevation / t2m, (9.80665 * 0.0289644) / (8.31432 * 0.0065)) AS surface_pressure
       FROM forecast JOIN locations USING (location_id)""")
def _(d):
    rows = d.forecast.join(d.locations.select("location_id", "elevation"), "location_id")
    return rows.select("location_id", "time", physics.surface_pressure(
        F.col("msl"), F.col("t2m"), F.col("elevation")).alias("surface_pressure"))


@query("air_density", tables="forecast", doubles="air_density",
       sql="SELECT location_id, time, msl / (t2m * 287.058) AS air_density FROM forecast")
def _(d):
    return d.forecast.select("location_id", "time", physics.air_density(F.col("msl"), F.col("t2m")).alias("air_density"))


@query("mixing_ratio_to_ugm3", tables="converted", doubles="pm25 o3 no2 so2 pm10",
       sql="SELECT location_id, time, pm25, o3, no2, so2, pm10 FROM converted")
def _(d):
    rows = series.upsample_linear(transform.rename_forecast_fields(d.forecast), FIELDS)
    return transform.convert_concentrations(rows, d.locations).select("location_id", "time", "pm25", "o3", "no2", "so2", "pm10")


@query("differentiate_accumulated", tables="hourly_forecast", doubles="dsrp tp uvb", coarse=COARSE, sql="""
       SELECT location_id, time, dsrp_forecast AS dsrp, tp_forecast AS tp, uvb_forecast AS uvb FROM hourly_forecast""")
def _(d):
    fields = ["dsrp", "tp", "uvb"]
    return series.differentiate_accumulated(series.upsample_linear(d.forecast, fields), fields)


def _reset_aware(c: str) -> str:
    return f"""greatest(0.0, coalesce(CASE
           WHEN lag({c}) OVER w IS NULL AND lead({c}) OVER w IS NULL THEN 0.0
           WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w
           ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END, 0.0)) AS {c}"""


@query("differentiate_reset_aware", tables="upsampled", doubles=" ".join(ACCUMULATED), coarse=COARSE, sql=f"""
       SELECT location_id, time, {', '.join(map(_reset_aware, ACCUMULATED))}
       FROM upsampled WINDOW w AS (PARTITION BY location_id, date_trunc('day', time) ORDER BY time)""")
def _(d):
    return series.differentiate_accumulated(series.upsample_linear(d.forecast, ACCUMULATED), ACCUMULATED, reset_aware=True)


# --- processed table ----------------------------------------------------------------------------


@query("merge_forecast_observed", tables="hourly_forecast observed", doubles=f"observed {ALL_FORECAST}", coarse=COARSE, sql=f"""
       SELECT location_id, time, variable, observed, {COLUMNS} FROM hourly_forecast FULL JOIN observed USING (location_id, time)""")
def _(d):
    return transform.merge_forecast_observed(d.hourly_forecast, d.hourly_observed, "outer").select(
        "location_id", "time", "variable", "observed", *ALL_FORECAST.split())


@query("processed_table", tables="processed", doubles=f"{ALL_FORECAST} observed forecast bias", coarse=COARSE,
       sql="SELECT * FROM processed")
def _(d):
    return d.processed_plan


@query("local_hour", tables="measurements locations", sql=f"""
       SELECT m.sensor_id, m.time, m.variable, l.location_id, {sql_local_hour('m.time', 'l.timezone')} AS local_time_hour
       FROM measurements m JOIN locations l ON l.location_id = {sql_location_id('(m.sensor_id // 30)')}""")
def _(d):
    m = d.measurements.withColumn("location_id", home_location_id(F.col("sensor_id")))
    return m.join(d.locations.select("location_id", "timezone"), "location_id").select(
        "sensor_id", "time", "variable", "location_id", local_hour(F.col("time"), F.col("timezone")).alias("local_time_hour"))


@query("bias", tables="processed", doubles="bias back",
       sql="SELECT location_id, variable, time, forecast - observed AS bias, observed + bias AS back FROM processed")
def _(d):
    rows = transform.add_bias(d.processed.select(*SERIES, "time", "forecast", "observed"))
    return rows.select(*SERIES, "time", "bias", (F.col("observed") + F.col("bias")).alias("back"))


@query("cyclic_time_features", tables="processed", doubles="hour_cos_aux hour_sin_aux month_cos_aux month_sin_aux", sql="""
       SELECT location_id, variable, time, cos(2 * pi() * local_time_hour / 24) AS hour_cos_aux,
              sin(2 * pi() * local_time_hour / 24) AS hour_sin_aux, cos(2 * pi() * month(time) / 12) AS month_cos_aux,
              sin(2 * pi() * month(time) / 12) AS month_sin_aux FROM processed""")
def _(d):
    return d.processed.select(*SERIES, "time", *time_features(F.col("local_time_hour"), F.col("time")))


SEASONAL = [*ALL_FORECAST.split(), "bias"]


@query("deseasonalise", tables="processed", doubles=" ".join(SEASONAL), coarse=COARSE, sql=f"""
       SELECT location_id, variable, time, {', '.join(f"{c} - avg({c}) OVER w AS {c}" for c in SEASONAL)}
       FROM processed WINDOW w AS (PARTITION BY location_id, variable, month(time))""")
def _(d):
    return series.deseasonalise(d.processed.select(*SERIES, "time", *SEASONAL), SEASONAL)


def _resample_sql(label: str) -> str:
    return (f"SELECT location_id, variable, {label} AS time, avg(forecast) AS forecast, avg(observed) AS observed, "
            f"avg(bias) AS bias FROM processed GROUP BY ALL")


@query("resample_mean_daily", tables="processed", doubles="forecast observed bias", sql=_resample_sql("date_trunc('day', time)"))
def _(d):
    return series.resample_mean(d.processed, "daily", ["forecast", "observed", "bias"])


@query("resample_mean_monthly", tables="processed", doubles="forecast observed bias",
       sql=_resample_sql("CAST(last_day(time) AS TIMESTAMP)"))
def _(d):
    return series.resample_mean(d.processed, "monthly", ["forecast", "observed", "bias"])


@query("persistence_24h", tables="processed", doubles="observed persistence", sql="""
       SELECT p.location_id, p.variable, p.time, p.observed, y.observed AS persistence FROM processed p
       LEFT JOIN processed y ON y.location_id = p.location_id AND y.variable = p.variable AND y.time = p.time - INTERVAL 24 HOUR""")
def _(d):
    return persistence_24h(d.processed.select(*SERIES, "time", "observed"))


@query("filter_country_city", tables="processed locations", doubles="bias", sql="""
       SELECT location_id, variable, time, city, bias FROM processed JOIN locations USING (location_id)
       WHERE country = 'Spain' AND city IN ('Madrid', 'Madrid 1', 'Barcelona')""")
def _(d):
    return explore.filter_country_city(d.processed, d.locations, "Spain", ["Madrid", "Madrid 1", "Barcelona"]).select(
        *SERIES, "time", "city", "bias")
