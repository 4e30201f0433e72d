"""Queries on exploratory tables and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skybias.operators import explore, metrics, reports
from skybias.plans.check_tables import pearson
from skybias.plans.registry import query
from skybias.schemas import FIELDS, RAW_FIELDS, SERIES
from skybias.sources.driver_tables import PERIOD

START, END = PERIOD
PLACES = ["location_id", "city"]
ERRORS = [*SERIES, "data"]


@query("hourly_bias", tables="processed locations", doubles="mean std", sql="""
       WITH p AS (SELECT * FROM processed JOIN locations USING (location_id)),
            grid AS (SELECT location_id, city, variable, unnest(range(24)) AS local_time_hour FROM (SELECT DISTINCT location_id, city, variable FROM p))
       SELECT location_id, city, variable, local_time_hour, avg(bias) AS mean, stddev_samp(bias) AS std
       FROM grid LEFT JOIN p USING (location_id, city, variable, local_time_hour) GROUP BY ALL""")
def _(d):
    rows = d.processed_plan.join(d.locations.select(*PLACES), "location_id")
    return explore.hourly_bias(rows, [*PLACES, "variable"])


@query("pivot_city", tables="processed locations", doubles="mean", sql="""
       WITH p AS (SELECT * FROM processed JOIN locations USING (location_id)),
            grid AS (SELECT variable, city, unnest(range(24)) AS local_time_hour FROM (SELECT DISTINCT variable FROM p), (SELECT DISTINCT city FROM p))
       SELECT variable, local_time_hour, city, avg(bias) AS mean FROM grid LEFT JOIN p USING (variable, city, local_time_hour) GROUP BY ALL""")
def _(d):
    rows = d.processed.join(d.locations.select(*PLACES), "location_id")
    matrix = explore.pivot_city(explore.hourly_bias(rows, [*PLACES, "variable"]))
    # the matrix with a row per cell, as its columns depend on the table
    return matrix.unpivot(["variable", "local_time_hour"], None, "city", "mean")


@query("monthly_bias", tables="processed", doubles="mean std", sql="""
       WITH grid AS (SELECT location_id, variable, unnest(range(1, 13)) AS month FROM (SELECT DISTINCT location_id, variable FROM processed))
       SELECT g.location_id, g.variable, g.month, avg(bias) AS mean, stddev_samp(bias) AS std, count(bias) AS count
       FROM grid g LEFT JOIN processed p ON p.location_id = g.location_id AND p.variable = g.variable AND month(p.time) = g.month
       GROUP BY g.location_id, g.variable, g.month""")
def _(d):
    return explore.monthly_bias(d.processed)


def _cycle_sql(unit: str) -> str:
    return (f"SELECT location_id, variable, data_type, {unit}(time) AS {unit}, avg(value) AS mean, stddev_samp(value) AS std "
            f"FROM stacked GROUP BY ALL")


@query("cycle_stats_hour", tables="stacked", doubles="mean std", sql=_cycle_sql("hour"))
def _(d):
    return explore.cycle_stats(d.validation, "hour")


@query("cycle_stats_month", tables="stacked", doubles="mean std", sql=_cycle_sql("month"))
def _(d):
    return explore.cycle_stats(d.validation, "month")


BOX = "q1 median q3 whisker_low whisker_high"


def _boxes(unit: str, by: str) -> str:
    kind = "data_type" if by == "type" else "data_type || ' - (' || split || ')'"
    name = {"type": "data_type", "kind": "data_kind"}[by]
    return f"""WITH v AS (SELECT location_id, variable, {kind} AS {name}, {unit}(time) AS {unit}, time, value FROM stacked),
        q AS (SELECT location_id, variable, {name}, {unit}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                     quantile_cont(value, 0.75) AS q3 FROM v GROUP BY ALL),
        j AS (SELECT *, value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) AS inside
              FROM v JOIN q USING (location_id, variable, {name}, {unit}))"""


def _box_sql(unit: str, by: str) -> str:
    name = {"type": "data_type", "kind": "data_kind"}[by]
    return f"""{_boxes(unit, by)} SELECT location_id, variable, {name}, {unit}, q1, median, q3,
        min(CASE WHEN inside THEN value END) AS whisker_low, max(CASE WHEN inside THEN value END) AS whisker_high,
        count(*) FILTER (NOT inside) AS outliers FROM j GROUP BY ALL"""


@query("box_stats_hour_type", tables="stacked", doubles=BOX, sql=_box_sql("hour", "type"))
def _(d):
    return explore.box_stats(d.validation, "hour", "type")


@query("box_stats_month_kind", tables="stacked", doubles=BOX, sql=_box_sql("month", "kind"))
def _(d):
    return explore.box_stats(d.validation, "month", "kind")


@query("box_outliers", tables="stacked", doubles="value",
       sql=f"{_boxes('hour', 'type')} SELECT location_id, variable, data_type, hour, time, value FROM j WHERE NOT inside")
def _(d):
    return explore.box_outliers(d.validation, "hour", "type")


def _histogram(source: str, keys: str, value: str) -> str:
    return f"""SELECT {keys}, bin, lo + bin * 5 AS bin_start, count(*) AS count, count(*) / any_value(total)::DOUBLE AS share
        FROM (SELECT {keys}, lo, total, CAST(least(floor(({value} - lo) / 5), greatest(ceil((hi - lo) / 5) - 1, 0)) AS BIGINT) AS bin
              FROM (SELECT *, min({value}) OVER w AS lo, max({value}) OVER w AS hi, count(*) OVER w AS total
                    FROM {source} WINDOW w AS (PARTITION BY {keys}))) GROUP BY {keys}, bin, lo"""


def _errors_sql(agg: str) -> str:
    means = ", ".join(f"avg({c}) AS {c}" for c in ("cams", "observations", "corrected", "persistence"))
    return f"""(WITH m AS (SELECT location_id, variable, date_trunc('{agg}', time) AS t, {means} FROM validation GROUP BY ALL)
        SELECT location_id, variable, 'CAMS Error' AS data, cams - observations AS value FROM m
        UNION ALL SELECT location_id, variable, 'Corrected CAMS Error', corrected - observations FROM m
        UNION ALL SELECT location_id, variable, 'Persistence Error', persistence - observations FROM m)"""


@query("error_histogram", tables="processed", doubles="bin_start share",
       sql=_histogram("processed", "location_id, variable", "bias"))
def _(d):
    return explore.error_histogram(d.processed, SERIES, "bias")


def _errors_histogram(d, agg):
    return explore.error_histogram(explore.validation_errors(d.validation, agg), ERRORS, "value")


@query("error_histogram_hour", tables="validation", doubles="bin_start share",
       sql=_histogram(_errors_sql("hour"), "location_id, variable, data", "value"))
def _(d):
    return _errors_histogram(d, "hour")


@query("error_histogram_day", tables="validation", doubles="bin_start share",
       sql=_histogram(_errors_sql("day"), "location_id, variable, data", "value"))
def _(d):
    return _errors_histogram(d, "day")


@query("error_histogram_month", tables="validation", doubles="bin_start share",
       sql=_histogram(_errors_sql("month"), "location_id, variable, data", "value"))
def _(d):
    return _errors_histogram(d, "month")


@query("error_cdf", tables="processed", doubles="bin_start share cumulative", sql=f"""
       SELECT *, sum(share) OVER (PARTITION BY location_id, variable ORDER BY bin) AS cumulative
       FROM ({_histogram("processed", "location_id, variable", "bias")})""")
def _(d):
    return explore.error_cdf(explore.error_histogram(d.processed, SERIES, "bias"), SERIES)


@query("error_density", tables="processed", doubles="x density", sql="""
       WITH s AS (SELECT location_id, variable, min(bias) AS lo, max(bias) AS hi, count(*) AS n,
                         stddev_samp(bias) * pow(count(*), -0.2) AS h FROM processed GROUP BY ALL),
            g AS (SELECT *, lo + (hi - lo) * point / 199.0 AS x FROM (SELECT *, unnest(range(200)) AS point FROM s WHERE h > 0))
       SELECT g.location_id, g.variable, g.point, g.x,
              sum(exp(-pow((g.x - p.bias) / g.h, 2) / 2)) / (any_value(g.n) * any_value(g.h) * sqrt(2 * pi())) * 5 AS density
       FROM g JOIN processed p ON p.location_id = g.location_id AND p.variable = g.variable
       GROUP BY g.location_id, g.variable, g.point, g.x
       UNION ALL SELECT location_id, variable, NULL, lo, NULL FROM s WHERE coalesce(h, 0) <= 0""")
def _(d):
    return explore.error_density(d.processed, SERIES, "bias")


@query("days_available", tables="processed locations", sql="""
       SELECT location_id, city, variable, count(DISTINCT date_trunc('day', time)) AS days
       FROM processed JOIN locations USING (location_id) GROUP BY ALL""")
def _(d):
    rows = d.processed.join(d.locations.select(*PLACES), "location_id")
    return explore.days_available(rows, ["forecast", "observed", "bias"], [*PLACES, "variable"])


@query("abs_rel_bias", tables="processed", doubles="abs_bias rel_bias", sql="""
       SELECT location_id, variable, -avg(bias) AS abs_bias, -avg(bias) / nullif(avg(observed), 0) AS rel_bias
       FROM processed GROUP BY ALL""")
def _(d):
    return explore.abs_rel_bias(d.processed)


@query("abs_rel_bias_daily", tables="processed", doubles="abs_bias rel_bias", sql="""
       WITH days AS (SELECT location_id, variable, date_trunc('day', time) AS day, avg(bias) AS b FROM processed GROUP BY ALL),
            a AS (SELECT location_id, variable, -avg(b) AS abs_bias FROM days GROUP BY ALL),
            o AS (SELECT location_id, variable, avg(observed) AS m FROM processed GROUP BY ALL)
       SELECT location_id, variable, abs_bias, abs_bias / nullif(m, 0) AS rel_bias FROM a JOIN o USING (location_id, variable)""")
def _(d):
    return explore.abs_rel_bias(d.processed, "daily")


def _correlation_sql(daily: bool) -> str:
    names = [*FIELDS, "error"]
    centred = ", ".join(f"{c} - avg({c}) OVER w AS {n}" for n, c in
                        [*((f, f"{f}_forecast") for f in FIELDS), ("error", "bias")])
    names = [*names, "error_raw"]
    averaged = ", ".join(f"avg({n}) AS {n}" for n in names)
    rows = (f"SELECT location_id, variable, date_trunc('day', time) AS time, {averaged} FROM s GROUP BY ALL" if daily
            else "SELECT * FROM s")
    number = ", ".join(f"'{n}'" for n in names)
    return f"""WITH s AS (SELECT location_id, variable, time, {centred}, bias AS error_raw FROM processed
                          WINDOW w AS (PARTITION BY location_id, variable, month(time))),
        r AS ({rows}), u AS (UNPIVOT r ON {', '.join(names)} INTO NAME f VALUE v)
        SELECT a.location_id, a.variable, a.f AS x, b.f AS y, {pearson('a.v', 'b.v')} AS r
        FROM u a JOIN u b ON a.location_id = b.location_id AND a.variable = b.variable AND a.time = b.time
         AND list_position([{number}], a.f) <= list_position([{number}], b.f) GROUP BY ALL"""


@query("correlation_matrix", tables="processed", doubles="r", sql=_correlation_sql(False))
def _(d):
    return explore.correlation_matrix(d.processed)


@query("correlation_matrix_daily", tables="processed", doubles="r", sql=_correlation_sql(True))
def _(d):
    return explore.correlation_matrix(d.processed, "daily")


@query("station_series", tables="processed", doubles="forecast observed", sql="""
       SELECT location_id, variable, strftime(time, '%d %b, %Y') AS date, time, observed + bias AS forecast, observed FROM processed""")
def _(d):
    return explore.station_series(d.processed)


@query("station_series_daily", tables="processed", doubles="forecast observed", sql="""
       SELECT location_id, variable, strftime(t, '%d %b, %Y') AS date, t AS time, o + b AS forecast, o AS observed
       FROM (SELECT location_id, variable, date_trunc('day', time) AS t, avg(observed) AS o, avg(bias) AS b FROM processed GROUP BY ALL)""")
def _(d):
    return explore.station_series(d.processed, "daily")


# --- reports ------------------------------------------------------------------------------------


@query("availability_report", tables="sensor_hours", doubles="pct_span pct_valid distance", sql=f"""
       WITH s AS (SELECT location_id, variable, count(*) AS sensors, list_sort(list(round(distance_km, 2))) AS ds
                  FROM (SELECT DISTINCT location_id, variable, sensor_id, distance_km FROM sensor_hours) GROUP BY ALL),
            n AS (SELECT (epoch(TIMESTAMP '{END}') - epoch(TIMESTAMP '{START}')) / 3600 + 1 AS wanted),
            h AS (SELECT location_id, variable, 100 * ((epoch(max(time)) - epoch(min(time))) / 3600 + 1) / any_value(wanted) AS pct_span,
                         100 * count(DISTINCT time) / any_value(wanted) AS pct_valid FROM sensor_hours, n GROUP BY location_id, variable)
       SELECT location_id, variable, sensors, round(pct_span, 2) AS pct_span, round(pct_valid, 2) AS pct_valid,
              unnest(range(len(ds))) AS rank, unnest(ds) AS distance FROM s JOIN h USING (location_id, variable)""")
def _(d):
    report = reports.availability_report(d.observations, START, END)
    return report.select(*SERIES, "sensors", "pct_span", "pct_valid", F.posexplode("distances").alias("rank", "distance"))


def _improvement_sql() -> str:
    names = {"nmae": "NMAE", "bias": "BIAS", "rmse": "RMSE", "debiased_nmae": "De-Biased NMAE", "pearson": "Pearson Correlation"}
    parts = []
    for m, label in names.items():
        change = {"bias": "100 * (abs(n) - abs(c)) / nullif(abs(c), 0)", "pearson": "100 * (n - c) / nullif(abs(c), 0)"}.get(
            m, "100 * (n - c) / nullif(c, 0)")
        parts.append(f"""SELECT location_id, variable, split, '{label}' AS metric, c AS cams, n AS corrected, {change} AS change_pct, runs
            FROM (SELECT location_id, variable, split, avg({m}) FILTER (type = 'CAMS') AS c,
                         avg({m}) FILTER (type = 'Corrected CAMS') AS n, count(DISTINCT init_time) AS runs FROM run_scores GROUP BY ALL)""")
    return " UNION ALL ".join(parts)


@query("improvement_report", tables="run_scores", doubles="cams corrected change_pct", sql=_improvement_sql())
def _(d):
    runs = metrics.score_runs(d.validation)
    return reports.improvement_report(metrics.score_runs_mean(runs), runs)


@query("location_status", tables="processed locations", sql="""
       SELECT l.location_id, count(p.time) AS rows, count(p.time) > 0 AS succeeded,
              CASE WHEN count(p.time) = 0 THEN 'no data' ELSE '' END AS reason
       FROM locations l LEFT JOIN (SELECT * FROM processed WHERE observed > 250) p USING (location_id) GROUP BY l.location_id""")
def _(d):
    return reports.location_status(d.locations, d.processed.where("observed > 250"))


@query("field_statistics", tables="forecast", doubles="mean std", coarse={"mean": 3, "std": 3}, sql="""
       SELECT variable, avg(value) AS mean, stddev_pop(value) AS std FROM (UNPIVOT forecast ON
         blh, d2m, dsrp, go3, msl, no2, pm10, pm2p5, so2, t2m, tcc, tp, u10, uvb, v10, z INTO NAME variable VALUE value)
       GROUP BY variable""")
def _(d):
    return reports.field_statistics(d.forecast, RAW_FIELDS)
