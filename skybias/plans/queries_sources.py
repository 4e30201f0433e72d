"""Queries on readers, writers, grids and input manifests. Written tables are read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from skybias.operators import metrics, reports, sensors, spatial, validation
from skybias.plans import jobs, resumable
from skybias.plans.check_tables import derived_from, to_ugm3
from skybias.plans.queries_scores import RUNS_SQL, SCORES, SERIES_SQL
from skybias.plans.queries_series import ALL_FORECAST, COARSE, END, RANKED_SQL, START
from skybias.plans.registry import query
from skybias.schemas import LEADS, POLLUTANTS, RAW_FIELDS, SERIES
from skybias.session import work_path
from skybias.sources import storage

PLACE = "location_id city country latitude longitude timezone elevation"
RAW = " ".join(RAW_FIELDS)

# --- locations, sensors, readings ---------------------------------------------------------------


@query("read_locations", tables="locations", doubles="latitude longitude elevation", sql="SELECT * FROM locations")
def _(d):
    path = work_path(d.spark, "locations")
    storage.write_locations(d.locations, path)
    return storage.read_locations(d.spark, path)


@query("location_by_id", tables="locations", doubles="latitude longitude elevation",
       sql="SELECT * FROM locations WHERE location_id = 'ES001'")
def _(d):
    return storage.location_by_id(d.locations, "ES001")


@query("list_countries", tables="locations", sql="SELECT DISTINCT country FROM locations")
def _(d):
    return storage.list_countries(d.locations)


def _catalogue(d):
    path = work_path(d.spark, "catalogue")
    d.tables.catalogue().write.json(path)
    return storage.read_sensor_catalogue(d.spark, path)


@query("read_sensor_catalogue", tables="measurements sensors", doubles="latitude longitude average", sql="""
       SELECT m.sensor_id, s.latitude, s.longitude, s.sensor_type, m.variable, count(*) AS count, avg(m.value) AS average
       FROM measurements m JOIN sensors s USING (sensor_id) GROUP BY ALL""")
def _(d):
    return (_catalogue(d).select(F.col("id").alias("sensor_id"), "coordinates.latitude", "coordinates.longitude",
                                 F.col("sensorType").alias("sensor_type"), F.explode("parameters").alias("p"))
            .select("sensor_id", "latitude", "longitude", "sensor_type", F.col("p.parameter").alias("variable"),
                    F.col("p.count").alias("count"), F.col("p.average").alias("average")))


@query("has_parameter", tables="measurements",
       sql="SELECT DISTINCT sensor_id FROM measurements WHERE variable = 'o3'")
def _(d):
    return sensors.has_parameter(_catalogue(d), "o3").select(F.col("id").alias("sensor_id"))


@query("read_measurements", tables="measurements", doubles="value", sql="""
       SELECT sensor_id, variable, time, value, unit FROM measurements WHERE variable = 'pm25' AND value >= 20""")
def _(d):
    return storage.read_measurements(d.measurements, "pm25", 20)


@query("attach_elevation", tables="sensors", doubles="latitude longitude elevation", sql="""
       SELECT a.sensor_id, a.latitude, a.longitude, b.elevation FROM sensors a LEFT JOIN (
         SELECT round(latitude, 4) AS lat, round(longitude, 4) AS lon, max(sensor_id * 10.0::DOUBLE) AS elevation
         FROM sensors WHERE sensor_type = 'reference grade' GROUP BY 1, 2) b
       ON round(a.latitude, 4) = b.lat AND round(a.longitude, 4) = b.lon""")
def _(d):
    places = d.tables.sensors().select("sensor_id", "latitude", "longitude", "sensor_type")
    table = places.where("sensor_type = 'reference grade'").select(
        "latitude", "longitude", (F.col("sensor_id") * 10.0).alias("elevation"))
    return spatial.attach_elevation(places.select("sensor_id", "latitude", "longitude"), table)


# --- gridded forecasts --------------------------------------------------------------------------


def _files(d):
    path = work_path(d.spark, "grid")
    storage.write_forecast_files(d.tables.grid_forecast(), path)
    return path


@query("scan_forecast_files", tables="grid", doubles="value", coarse={"value": 3}, sql="""
       SELECT latitude, longitude, time, variable, value, init_date, lead_h FROM grid WHERE init_date = '20240110'""")
def _(d):
    return storage.scan_forecast_files(d.spark, _files(d), "20240110").select(
        "latitude", "longitude", "time", "variable", "value", "init_date", "lead_h")


@query("nearest_grid_cell", tables="cells", doubles="cell_latitude cell_longitude", sql="SELECT * FROM cells")
def _(d):
    return spatial.nearest_grid_cell(d.locations, spatial.grid_axes(d.tables.grid_forecast())).select(
        "location_id", "cell_latitude", "cell_longitude")


@query("nearest_grid_cell_no_wrap", tables="grid locations", doubles="cell_latitude cell_longitude", sql="""
       SELECT l.location_id,
              (SELECT latitude FROM (SELECT DISTINCT latitude FROM grid) g
               ORDER BY abs(g.latitude - l.latitude), g.latitude DESC LIMIT 1) AS cell_latitude,
              (SELECT longitude FROM (SELECT DISTINCT longitude FROM grid) g
               ORDER BY abs(g.longitude - l.longitude), g.longitude DESC LIMIT 1) AS cell_longitude FROM locations l""")
def _(d):
    return spatial.nearest_grid_cell(d.locations, spatial.grid_axes(d.tables.grid_forecast()), wrap=False).select(
        "location_id", "cell_latitude", "cell_longitude")


@query("merge_forecast_fields", tables="grid", doubles=RAW, coarse=COARSE, sql=f"""
       SELECT latitude, longitude, time, {', '.join(f"max(value) FILTER (variable = '{f}') AS {f}" for f in RAW_FIELDS)}
       FROM grid GROUP BY latitude, longitude, time""")
def _(d):
    return storage.merge_forecast_fields(d.tables.grid_forecast(), ["latitude", "longitude", "time"])


@query("job_forecasts", tables="grid cells", doubles=RAW, coarse=COARSE, sql=f"""
       SELECT c.location_id, g.time, {', '.join(f"max(value) FILTER (variable = '{f}') AS {f}" for f in RAW_FIELDS)}
       FROM cells c JOIN grid g ON g.latitude = c.cell_latitude AND g.longitude = c.cell_longitude
       GROUP BY c.location_id, g.time""")
def _(d):
    return jobs.job_forecasts(d.locations, d.tables.grid_forecast())


def _bounds(d):
    return d.tables.events().agg(F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("end"))


DATES = """SELECT strftime(unnest(generate_series(CAST(min(ts) AS DATE)::TIMESTAMP, CAST(max(ts) AS DATE)::TIMESTAMP + INTERVAL 1 DAY,
           INTERVAL 1 DAY)), '%Y%m%d') AS init_date FROM events"""
_EXPECTED = (f"SELECT init_date, variable, CAST(lead_h AS BIGINT) AS lead_h, lpad(CAST(lead_h AS VARCHAR), 3, '0') AS lead "
             f"FROM ({DATES}), (SELECT unnest({RAW_FIELDS}) AS variable), (SELECT unnest({LEADS}) AS lead_h)")


@query("initialization_times", sql=DATES)
def _(d):
    return reports.initialization_times(_bounds(d))


@query("expected_forecast_inputs", sql=_EXPECTED)
def _(d):
    return reports.expected_forecast_inputs(_bounds(d))


@query("missing_forecast_inputs", tables="grid", sql=f"""
       SELECT * FROM ({_EXPECTED}) e WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.init_date = e.init_date
         AND g.variable = e.variable AND g.lead_h = e.lead_h)""")
def _(d):
    return reports.missing_forecast_inputs(_bounds(d), d.tables.grid_forecast())


# --- jobs and sinks -----------------------------------------------------------------------------

JOB_OBSERVATIONS = f"""
    SELECT c.location_id, m.sensor_id, m.variable, m.time, {to_ugm3('m.value', 'm.unit', 'm.variable')} AS value, c.distance_km
    FROM (SELECT *, row_number() OVER (PARTITION BY location_id, variable ORDER BY rank_key, sensor_id) AS position
          FROM ({RANKED_SQL}) r WHERE (sensor_id, variable) IN (
            SELECT (sensor_id, variable) FROM measurements WHERE time > TIMESTAMP '{START}' AND time <= TIMESTAMP '{END}'
            GROUP BY sensor_id, variable HAVING count(DISTINCT unit) = 1)) c
    JOIN measurements m USING (sensor_id, variable)
    WHERE c.position <= 5 AND m.time > TIMESTAMP '{START}' AND m.time <= TIMESTAMP '{END}'"""


def _job_observations(d):
    return jobs.job_observations(d.locations, d.sensors, d.measurements, START, END)


@query("job_observations", tables="candidates measurements", doubles="value distance_km", sql=JOB_OBSERVATIONS)
def _(d):
    return _job_observations(d).select("location_id", "sensor_id", "variable", "time", "value", "distance_km")


@query("write_observations", tables="candidates measurements locations", doubles="value distance_km", sql=f"""
       SELECT o.*, replace(lower(l.country), ' ', '-') AS country_slug, replace(lower(l.city), ' ', '-') AS city_slug,
              replace(lower(l.location_id), ' ', '-') AS id_slug, '20240101_20240131' AS time_range_slug
       FROM ({JOB_OBSERVATIONS}) o JOIN locations l USING (location_id)""")
def _(d):
    path = work_path(d.spark, "observations")
    storage.write_observations(_job_observations(d), d.locations, path, START, END)
    return d.spark.read.parquet(path).select("location_id", "sensor_id", "variable", "time", "value", "distance_km",
                                             "country_slug", "city_slug", "id_slug", "time_range_slug")


@query("write_forecast", tables="forecast locations", doubles=RAW, coarse=COARSE, sql="""
       SELECT f.*, replace(lower(l.country), ' ', '-') AS country_slug FROM forecast f JOIN locations l USING (location_id)""")
def _(d):
    path = work_path(d.spark, "forecast")
    storage.write_forecast(d.forecast, d.locations, path, START, END)
    return d.spark.read.parquet(path).select("location_id", "time", *RAW_FIELDS, "country_slug")


@query("write_processed", tables="processed", doubles=f"{ALL_FORECAST} observed forecast bias", coarse=COARSE,
       sql="SELECT * FROM processed")
def _(d):
    path = work_path(d.spark, "processed-again")
    storage.write_processed(d.processed, path)
    return storage.read_processed(d.spark, path)


@query("export_processed_csv", tables="processed", doubles="observed forecast bias",
       sql="SELECT location_id, variable, time, observed, forecast, bias FROM processed")
def _(d):
    path = work_path(d.spark, "csv")
    rows = d.processed.select(*SERIES, "time", "observed", "forecast", "bias")
    storage.export_processed_csv(rows, path)
    schema = "location_id STRING, time TIMESTAMP, observed DOUBLE, forecast DOUBLE, bias DOUBLE, variable STRING"
    return d.spark.read.schema(schema).option("header", True).csv(path).select("time", "observed", "forecast", "bias", "variable", "location_id")


@query("only_missing", tables="observations processed", sql="""
       SELECT DISTINCT location_id, variable, date_trunc('day', time) AS day FROM observations
       WHERE (location_id, variable, date_trunc('day', time)) NOT IN (
         SELECT (location_id, variable, date_trunc('day', time)) FROM processed GROUP BY ALL HAVING count(*) = 24)""")
def _(d):
    day = F.date_trunc("day", "time").alias("day")
    todo = d.observations.select(*SERIES, day).distinct()
    done = d.processed.groupBy(*SERIES, day).count().where("count = 24")
    return storage.only_missing(todo, done, [*SERIES, "day"])


@query("write_predictions", tables="predictions", doubles=" ".join(str(h) for h in range(1, 25)), sql=f"""
       SELECT location_id, variable, split, member, init_time,
              {', '.join(f'max(bias_hat) FILTER (horizon = {h - 1}) AS "{h}"' for h in range(1, 25))}
       FROM predictions GROUP BY location_id, variable, split, member, init_time""")
def _(d):
    path = work_path(d.spark, "predictions")
    storage.write_predictions(d.predictions, path)
    return storage.wide_predictions(storage.read_predictions(d.spark, path))


@query("write_metric_tables", tables="run_scores resampled", doubles=SCORES, sql=f"""
       SELECT 'set_of_runs' AS table_name, location_id, variable, split, type, run AS part, {SCORES.replace(' ', ', ')} FROM ({RUNS_SQL})
       UNION ALL SELECT 'complete_series', location_id, variable, split, type, resampling, {SCORES.replace(' ', ', ')} FROM ({SERIES_SQL})""")
def _(d):
    path = work_path(d.spark, "metrics")
    storage.write_metric_tables(metrics.score_runs_mean(metrics.score_runs(d.validation)), metrics.score_series(d.validation), path)
    parts = [d.spark.read.parquet(f"{path}/{t}").select(F.lit(t).alias("table_name"), *SERIES, "split", "type", F.col(c).alias("part"), *SCORES.split())
             for t, c in (("set_of_runs", "run"), ("complete_series", "resampling"))]
    return parts[0].unionByName(parts[1])


@query("write_corrected_forecast", tables="bias_hat processed", doubles="cams corrected", sql="""
       SELECT b.location_id, b.variable, b.init_time, p.time, p.forecast AS cams, p.forecast - b.bias_hat AS corrected,
              strftime(b.init_time, '%Y-%m-%d') AS end_date
       FROM bias_hat b JOIN processed p ON p.location_id = b.location_id AND p.variable = b.variable
        AND p.time = b.init_time + to_hours(b.horizon)""")
def _(d):
    path = work_path(d.spark, "corrected")
    storage.write_corrected_forecast(validation.correct_forecast(d.processed, d.bias_hat), path)
    return d.spark.read.parquet(path).withColumn("end_date", F.date_format("end_date", "yyyy-MM-dd"))


# --- the chain in jobs that can be run again ----------------------------------------------------

_JOB_FORECAST = f"""
    SELECT c.location_id, g.time, {', '.join(f"max(value) FILTER (variable = '{f}') AS {f}" for f in RAW_FIELDS)}
    FROM cells c JOIN grid g ON g.latitude = c.cell_latitude AND g.longitude = c.cell_longitude
    WHERE g.time >= TIMESTAMP '{START}' AND g.time < TIMESTAMP '{END}' + INTERVAL 2 DAY GROUP BY c.location_id, g.time"""
_CHAIN = derived_from({"observations": JOB_OBSERVATIONS, "forecast": _JOB_FORECAST}, "processed", ["candidates", "measurements", "grid", "cells", "locations"])


def _chain(d):
    """Folder and rows of the chain, run for some of the locations and then for all; both queries read the same runs."""
    if "chain" not in d.runs:
        path, files = work_path(d.spark, "chain"), _files(d)
        for places in (d.locations.where("latitude < 40"), d.locations):
            rows = resumable.run_chain(path, places, d.sensors, d.measurements, files, START, END)
        d.runs["chain"] = path, rows
    return d.runs["chain"]


@query("job_transform", tables="candidates measurements grid cells locations", doubles=f"{ALL_FORECAST} observed forecast bias", coarse=COARSE, sql=_CHAIN)
def _(d):
    return _chain(d)[1]


@query("job_status", tables="candidates measurements grid cells locations", sql=f"""
       SELECT * FROM (WITH processed_rows AS ({_CHAIN}), places AS (SELECT location_id, unnest({POLLUTANTS}) AS variable FROM locations),
            counts AS (
              SELECT 'observations' AS job, location_id, variable, count(*) AS n FROM ({JOB_OBSERVATIONS}) GROUP BY ALL
              UNION ALL SELECT 'transform', location_id, variable, count(*) FROM processed_rows GROUP BY ALL
              UNION ALL SELECT 'forecasts', location_id, '', count(*) FROM ({_JOB_FORECAST}) GROUP BY ALL),
            jobs AS (SELECT 'observations' AS job, * FROM places UNION ALL SELECT 'transform', * FROM places
                     UNION ALL SELECT 'forecasts', location_id, '' FROM locations)
       SELECT j.job, j.location_id, j.variable, coalesce(n, 0) AS rows, n IS NOT NULL AS succeeded,
              CASE WHEN n IS NULL THEN 'no data' ELSE '' END AS reason
       FROM jobs j LEFT JOIN counts c ON c.job = j.job AND c.location_id = j.location_id AND c.variable = j.variable)""")
def _(d):
    """Every place of the three jobs once, with its rows or the reason for none."""
    path, _rows = _chain(d)
    parts = [resumable.manifest(d.spark, f"{path}/{job}", keys) for job, keys in
             (("observations", SERIES), ("processed", SERIES), ("forecasts", ["location_id"]))]
    parts[2] = parts[2].withColumn("variable", F.lit(""))
    columns = ["job", "location_id", "variable", "rows", "succeeded", "reason"]
    return parts[0].select(*columns).union(parts[1].select(*columns)).union(parts[2].select(*columns))
