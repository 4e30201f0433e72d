"""The derived tables in DuckDB SQL, written on their own from the definitions: dense grids, plain joins."""

from __future__ import annotations

from skybias.schemas import ACCUMULATED, FIELD_RENAMES, FIELDS, POLLUTANTS, RAW_FIELDS
from skybias.sources.driver_tables import EVENT_VARIABLES, STATIONS, USERS_PER_LOCATION


def station(name: str, k: str) -> str:
    values = ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in STATIONS[name])
    return f"([{values}])[({k} % 5) + 1]"


def _home(k: str) -> tuple[str, str]:
    lon = f"({station('longitude', k)} + (({k} // 5) % 120) * 3)"
    return (f"({station('latitude', k)} + (({k} // 5) % 9) * 2)",
            f"(CASE WHEN {lon} >= 180 THEN {lon} - 360 ELSE {lon} END)")


def location_id(k: str) -> str:
    return f"({station('location_id', k)} || CASE WHEN {k} >= 5 THEN '-' || ({k} // 5) ELSE '' END)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(2 * 6373.0 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))")


def to_ugm3(value: str, unit: str, variable: str) -> str:
    return (f"CASE WHEN {unit} = 'ppm' AND {variable} = 'o3' THEN {value} * 0.0409 * 48.00 * 1e3 "
            f"WHEN {unit} = 'ppm' AND {variable} = 'no2' THEN {value} * 0.0409 * 46.01 * 1e3 ELSE {value} END")


def local_hour(time: str, zone: str) -> str:
    return f"CAST(extract(hour FROM (({time} AT TIME ZONE 'UTC') AT TIME ZONE {zone})) AS BIGINT)"


def pearson(x: str, y: str) -> str:
    return f"(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0))"


_lat, _lon = _home("(user_id // 30)")
_in_ppm = ("event_type IN ('view', 'purchase') AND (user_id % 4 = 0 OR (user_id % 10 = 9 AND event_id % 2 = 0))")
_variable = " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in EVENT_VARIABLES.items())
_field_sql = {
    "blh": "100 + v", "d2m": "270 + v / 10", "dsrp": "run * 1000", "go3": "v * 1e-9", "msl": "100000 + v * 10",
    "no2": "v * 1e-10", "pm10": "v * 2e-10", "pm2p5": "v * 1e-9", "so2": "v * 1e-11", "t2m": "273.15 + v / 10",
    "tcc": "least(1.0, v / 100)", "tp": "run / 100000", "u10": "v / 10 - 5", "uvb": "run * 100", "v10": "5 - v / 10",
    "z": "5000 + v"}
_density = ("(msl * pow(1 + (-0.0065 / t2m) * elevation, (9.80665 * 0.0289644) / (8.31432 * 0.0065)) "
            "/ (t2m * 287.058))")


def _rate(c: str) -> str:
    w = "OVER (PARTITION BY location_id ORDER BY time)"
    return (f"greatest(0.0, coalesce(CASE WHEN lag({c}) {w} IS NULL AND lead({c}) {w} IS NULL THEN 0.0 "
            f"WHEN lag({c}) {w} IS NULL THEN lead({c}) {w} - {c} WHEN lead({c}) {w} IS NULL THEN {c} - lag({c}) {w} "
            f"ELSE (lead({c}) {w} - lag({c}) {w}) / 2 END, 0.0))")


def upsample(table: str, key: str, fields: list[str]) -> str:
    """Dense hourly grid, then the knots around every hour."""
    around = ", ".join(f"a.{f} + CASE WHEN g.time = a.time THEN 0 ELSE (b.{f} - a.{f}) * "
                       f"(epoch(g.time) - epoch(a.time)) / (epoch(b.time) - epoch(a.time)) END AS {f}" for f in fields)
    return (f"WITH span AS (SELECT {key}, min(time) AS t0, max(time) AS t1 FROM {table} GROUP BY {key}), "
            f"grid AS (SELECT {key}, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS time FROM span), "
            f"knots AS (SELECT *, lead(time) OVER (PARTITION BY {key} ORDER BY time) AS nt FROM {table}) "
            f"SELECT g.{key}, g.time, {around} FROM grid g ASOF JOIN knots a ON g.{key} = a.{key} AND g.time >= a.time "
            f"LEFT JOIN {table} b ON b.{key} = a.{key} AND b.time = a.nt")


_rename = ", ".join(f"{f} AS {FIELD_RENAMES.get(f, f)}" for f in RAW_FIELDS)

TABLES: dict[str, tuple[str, str]] = {  # name: (tables it needs, SQL)
    "ev": ("", f"SELECT *, user_id // {USERS_PER_LOCATION} AS k FROM events"),
    "locations": ("ev", f"""
        SELECT {location_id('k')} AS location_id,
               {station('city', 'k')} || CASE WHEN k >= 5 THEN ' ' || (k // 5) ELSE '' END AS city,
               {station('country', 'k')} AS country, {_home('k')[0]} AS latitude, {_home('k')[1]} AS longitude,
               {station('timezone', 'k')} AS timezone, {station('elevation', 'k')} AS elevation
        FROM (SELECT DISTINCT k FROM ev)"""),
    "measurements": ("", f"""
        SELECT user_id AS sensor_id, CASE event_type {_variable} END AS variable, ts AS time,
               CASE WHEN event_type IN ('view', 'purchase') AND user_id % 4 = 0 THEN value / 1000 ELSE value END AS value,
               CASE WHEN {_in_ppm} THEN 'ppm' ELSE 'µg/m³' END AS unit FROM events"""),
    "sensors": ("", f"""
        SELECT user_id AS sensor_id, {_lat} + ((user_id * 7) % 201 - 100) / 100.0::DOUBLE * 1.2 AS latitude,
               {_lon} + ((user_id * 11) % 201 - 100) / 100.0::DOUBLE * 1.2 AS longitude,
               CASE WHEN user_id % 3 = 0 THEN 'low-cost sensor' ELSE 'reference grade' END AS sensor_type,
               TIMESTAMP '2023-12-20' + to_days(CAST(user_id % 30 AS INTEGER)) AS first_updated,
               TIMESTAMP '2024-01-10' + to_days(CAST((user_id * 13) % 35 AS INTEGER)) AS last_updated
        FROM (SELECT DISTINCT user_id FROM events)"""),
    "sensor_variables": ("sensors measurements", """
        SELECT * FROM (SELECT DISTINCT sensor_id, variable FROM measurements) JOIN sensors USING (sensor_id)"""),
    "pairs": ("locations sensor_variables", f"""
        SELECT l.location_id, s.sensor_id, s.variable, s.sensor_type, s.first_updated, s.last_updated,
               s.latitude AS y, s.longitude AS x, l.latitude AS _y, l.longitude AS _x,
               {haversine('l.latitude', 'l.longitude', 's.latitude', 's.longitude')} AS distance_km
        FROM locations l JOIN sensor_variables s
          ON {haversine('l.latitude', 'l.longitude', 's.latitude', 's.longitude')} <= 100"""),
    "candidates": ("pairs", """
        SELECT * FROM pairs p WHERE sensor_type = 'reference grade' OR NOT EXISTS (
          SELECT 1 FROM pairs r WHERE r.location_id = p.location_id AND r.variable = p.variable
                                  AND r.sensor_type = 'reference grade')"""),
    "one_unit": ("measurements", """
        SELECT * FROM measurements m WHERE (sensor_id, variable) IN (
          SELECT (sensor_id, variable) FROM measurements GROUP BY sensor_id, variable HAVING count(DISTINCT unit) = 1)"""),
    "observations": ("candidates one_unit", f"""
        SELECT c.location_id, m.sensor_id, m.variable, m.time, {to_ugm3('m.value', 'm.unit', 'm.variable')} AS value,
               c.distance_km FROM candidates c JOIN one_unit m USING (sensor_id, variable)"""),
    "sensor_hours": ("observations", """
        SELECT location_id, variable, sensor_id, distance_km, date_trunc('hour', time) AS time, avg(value) AS value
        FROM observations GROUP BY ALL"""),
    "weighted": ("sensor_hours", """
        SELECT location_id, variable, time, sum(w * value) / sum(w) AS observed
        FROM (SELECT *, CASE WHEN distance_km <= 1 THEN 1.0::DOUBLE
                             ELSE CAST(round_even(100 / distance_km, 0) AS DOUBLE) / 100 END AS w FROM sensor_hours)
        GROUP BY location_id, variable, time"""),
    "bounds": ("weighted", """
        SELECT location_id, variable, q1, q3, q3 - q1 AS iqr, q3 + 20 * (q3 - q1) AS threshold
        FROM (SELECT location_id, variable, quantile_cont(observed, 0.25) AS q1, quantile_cont(observed, 0.75) AS q3
              FROM weighted GROUP BY location_id, variable)"""),
    "filtered": ("weighted bounds", """
        SELECT w.* FROM weighted w JOIN bounds USING (location_id, variable) WHERE observed < threshold"""),
    "observed": ("filtered", """
        WITH series AS (SELECT *, location_id || ' ' || variable AS s FROM filtered),
             span AS (SELECT location_id, variable, s, min(time) AS t0, max(time) AS t1 FROM series GROUP BY ALL),
             grid AS (SELECT location_id, variable, s, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS time FROM span),
             knots AS (SELECT *, lead(time) OVER (PARTITION BY s ORDER BY time) AS nt,
                              lead(observed) OVER (PARTITION BY s ORDER BY time) AS nv FROM series)
        SELECT g.location_id, g.variable, g.time,
               CASE WHEN g.time = a.time THEN a.observed
                    ELSE a.observed + (a.nv - a.observed) * (epoch(g.time) - epoch(a.time)) / (epoch(a.nt) - epoch(a.time)) END AS observed
        FROM grid g ASOF JOIN knots a ON g.s = a.s AND g.time >= a.time
        WHERE g.time = a.time OR a.nt - a.time <= INTERVAL 12 HOUR"""),
    "forecast": ("ev", f"""
        SELECT {location_id('k')} AS location_id, time, {', '.join(f'{_field_sql[f]} AS {f}' for f in RAW_FIELDS)}
        FROM (SELECT k, time, v, sum(sv) OVER (PARTITION BY k, date_trunc('day', time) ORDER BY time) AS run
              FROM (SELECT k, time_bucket(INTERVAL 3 HOUR, ts) AS time, avg(value) AS v, sum(value) AS sv
                    FROM ev GROUP BY 1, 2))"""),
    "renamed": ("forecast", f"SELECT location_id, time, {_rename} FROM forecast"),
    "upsampled": ("renamed", upsample("renamed", "location_id", FIELDS)),
    "converted": ("upsampled locations", f"""
        SELECT u.* REPLACE ({', '.join(f'{p} * {_density} * 1e9 AS {p}' for p in POLLUTANTS)})
        FROM upsampled u JOIN locations USING (location_id)"""),
    "hourly_forecast": ("converted", f"""
        SELECT location_id, time, {', '.join(f'{_rate(f) if f in ACCUMULATED else f} AS {f}_forecast' for f in FIELDS)}
        FROM converted"""),
    "processed": ("hourly_forecast observed locations", f"""
        SELECT *, forecast - observed AS bias FROM (
          SELECT f.*, o.variable, o.observed,
                 CASE o.variable {' '.join(f"WHEN '{p}' THEN f.{p}_forecast" for p in POLLUTANTS)} END AS forecast,
                 {local_hour('f.time', 'l.timezone')} AS local_time_hour
          FROM hourly_forecast f JOIN observed o USING (location_id, time) JOIN locations l USING (location_id))
        WHERE observed >= 0 AND forecast IS NOT NULL"""),
    "prediction_rows": ("processed", """
        SELECT location_id, variable, bias, init AS init_time,
               CAST((epoch(time) + 86400 - epoch(init)) / 3600 AS BIGINT) AS horizon
        FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, time + INTERVAL 24 HOUR),
                                time_bucket(INTERVAL 12 HOUR, time + INTERVAL 24 HOUR) - INTERVAL 12 HOUR]) AS init
              FROM processed)"""),
    "runs": ("prediction_rows", """
        SELECT location_id, variable, init_time, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY location_id, variable ORDER BY init_time) AS r,
                     count(*) OVER (PARTITION BY location_id, variable) AS n
              FROM (SELECT DISTINCT location_id, variable, init_time FROM prediction_rows))"""),
    "predictions": ("prediction_rows runs", """
        SELECT location_id, variable, split, member, init_time, horizon, bias * (0.8 + member * 0.1) AS bias_hat
        FROM (SELECT *, unnest(range(5)) AS member FROM prediction_rows) JOIN runs USING (location_id, variable, init_time)"""),
    "bias_hat": ("predictions", """
        SELECT location_id, variable, split, init_time, horizon,
               CASE WHEN count(bias_hat) = 5 THEN avg(bias_hat) END AS bias_hat
        FROM predictions GROUP BY ALL"""),
    "validation_hours": ("bias_hat processed", """
        SELECT b.location_id, b.variable, b.split, b.init_time, b.horizon, p.time, p.forecast AS cams,
               p.observed AS observations, p.forecast - b.bias_hat AS corrected, y.observed AS persistence
        FROM bias_hat b
        JOIN processed p ON p.location_id = b.location_id AND p.variable = b.variable
                        AND p.time = b.init_time + to_hours(b.horizon)
        JOIN processed y ON y.location_id = b.location_id AND y.variable = b.variable
                        AND y.time = p.time - INTERVAL 24 HOUR
        WHERE b.bias_hat IS NOT NULL"""),
    "validation": ("validation_hours", """
        SELECT * FROM validation_hours v WHERE (location_id, variable, split, init_time) IN (
          SELECT (location_id, variable, split, init_time) FROM validation_hours GROUP BY ALL HAVING count(*) = 24)"""),
    "by_type": ("validation", """
        SELECT location_id, variable, split, init_time, time, observations, 'CAMS' AS type, cams AS forecast FROM validation
        UNION ALL SELECT location_id, variable, split, init_time, time, observations, 'Corrected CAMS', corrected FROM validation
        UNION ALL SELECT location_id, variable, split, init_time, time, observations, 'Persistence', persistence FROM validation"""),
    "stacked": ("by_type validation", """
        SELECT location_id, variable, split, init_time, time, type AS data_type, forecast AS value FROM by_type
        UNION ALL SELECT location_id, variable, split, init_time, time, 'Observations', observations FROM validation"""),
}


def score(keys: str, source: str) -> str:
    """The five scores of ``forecast`` against ``observations`` per group."""
    return (f"SELECT {keys}, avg(abs(e)) / nullif(avg(observations), 0) AS nmae, avg(e) AS bias, sqrt(avg(e * e)) AS rmse, "
            f"avg(abs(e - me)) / nullif(avg(observations), 0) AS debiased_nmae, {pearson('forecast', 'observations')} AS pearson "
            f"FROM (SELECT *, forecast - observations AS e, avg(forecast - observations) OVER (PARTITION BY {keys}) AS me "
            f"FROM {source}) GROUP BY {keys}")


TABLES["grid"] = ("forecast locations", f"""
    WITH long AS (UNPIVOT forecast ON {', '.join(RAW_FIELDS)} INTO NAME variable VALUE value),
         home AS (SELECT location_id, round(latitude) AS lat0, ((round(longitude) % 360) + 360) % 360 AS lon0 FROM locations)
    SELECT lat0 + i AS latitude, (lon0 + j) % 360 AS longitude, time, variable, avg(value * (1 + i * 0.1 + j * 0.05)) AS value,
           strftime(time, '%Y%m%d') AS init_date, CAST(hour(time) AS BIGINT) AS lead_h
    FROM long JOIN home USING (location_id), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(i, j) GROUP BY ALL""")
TABLES["cells"] = ("grid locations", """
    SELECT l.location_id,
           (SELECT latitude FROM (SELECT DISTINCT latitude FROM grid) g
            ORDER BY abs(g.latitude - l.latitude), g.latitude DESC LIMIT 1) AS cell_latitude,
           (SELECT longitude FROM (SELECT DISTINCT longitude FROM grid) g
            ORDER BY least((((g.longitude - l.longitude) % 360) + 360) % 360, (((l.longitude - g.longitude) % 360) + 360) % 360),
                     g.longitude DESC LIMIT 1) AS cell_longitude
    FROM locations l""")
TABLES["sample_steps"] = ("processed", """
    SELECT * FROM (
      SELECT a.location_id, a.variable, a.time + INTERVAL 24 HOUR AS init_time,
             CAST((epoch(p.time) - epoch(a.time)) / 3600 AS BIGINT) AS step, p.* EXCLUDE (location_id, variable),
             count(*) OVER (PARTITION BY a.location_id, a.variable, a.time) AS n
      FROM processed a JOIN processed p ON p.location_id = a.location_id AND p.variable = a.variable
       AND p.time BETWEEN a.time AND a.time + INTERVAL 47 HOUR
      WHERE hour(a.time) IN (0, 12)) WHERE n = 48""")
TABLES["sample_splits"] = ("sample_steps", """
    SELECT location_id, variable, init_time, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY location_id, variable ORDER BY init_time) AS r,
                 count(*) OVER (PARTITION BY location_id, variable) AS n
          FROM (SELECT DISTINCT location_id, variable, init_time FROM sample_steps))""")
TABLES["labelled"] = ("predictions processed", """
    SELECT r.*, p.bias AS label FROM predictions r JOIN processed p ON p.location_id = r.location_id
       AND p.variable = r.variable AND p.time = r.init_time + to_hours(r.horizon)""")
_means = ", ".join(f"avg({c}) AS {c}" for c in ("cams", "observations", "corrected", "persistence"))


def _bins(label: str, hours: int) -> str:
    return (f"SELECT location_id, variable, split, '{label}' AS resampling, o + to_hours(CAST(floor((epoch(time) - epoch(o)) / "
            f"{hours * 3600}) * {hours} AS BIGINT)) AS bin, 0 AS run, {_means} FROM anchored GROUP BY ALL")


TABLES["anchored"] = ("validation", """
    SELECT *, date_trunc('day', min(time) OVER (PARTITION BY location_id, variable, split)) AS o FROM validation""")
TABLES["resampled"] = ("anchored", " UNION ALL ".join(
    [_bins(k, h) for k, h in (("H", 1), ("3H", 3), ("6H", 6), ("12H", 12), ("D", 24), ("3D", 72), ("7D", 168), ("15D", 360))]
    + [f"SELECT location_id, variable, split, '{k}', date_trunc('{u}', time), 0, {_means} FROM anchored GROUP BY ALL"
       for k, u in (("MS", "month"), ("QS", "quarter"))]
    + ["SELECT location_id, variable, split, 'No Resampling', time, CAST(epoch(init_time) AS BIGINT), cams, observations, "
       "corrected, persistence FROM anchored"]))
TABLES["run_scores"] = ("by_type", score("location_id, variable, split, init_time, type", "by_type"))


def with_tables(names: list[str], body: str) -> str:
    """``body`` preceded by the named tables and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for needed in TABLES[name][0].split():
            add(needed)
        order.append(name)

    for name in names:
        add(name)
    if not order:
        return body
    ctes = ", ".join(f"{name} AS MATERIALIZED ({TABLES[name][1].strip()})" for name in order)
    return f"WITH {ctes} {body}"


def derived_from(roots: dict[str, str], name: str, given: list[str]) -> str:
    """Table ``name`` as it follows when ``roots`` (SQL over the ``given`` tables) replace the tables of their names."""
    order: list[str] = list(roots)

    def add(table: str) -> None:
        if table in order or table in given:
            return
        for needed in TABLES[table][0].split():
            add(needed)
        order.append(table)

    add(name)
    ctes = ", ".join(f"{t} AS MATERIALIZED ({(roots[t] if t in roots else TABLES[t][1]).strip()})" for t in order)
    return f"SELECT * FROM (WITH {ctes} SELECT * FROM {name})"
