"""Time-series operators on tables keyed by series and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skybias.functions.stats import weighted_avg
from skybias.operators.chunks import own_rows, spread, with_next
from skybias.operators.quantiles import exact_quantiles
from skybias.schemas import ACCUMULATED, SERIES


def hourly_mean(df: DataFrame, keys: list[str], value: str = "value", time: str = "time") -> DataFrame:
    """Mean per hour, labelled by the hour's start. Combined map-side: a hot series shrinks before the shuffle."""
    return (df.groupBy(*keys, F.date_trunc("hour", F.col(time)).alias("time"))
            .agg(F.avg(value).alias(value)))


def distance_weight(distance_km: Column) -> Column:
    """1 up to one kilometre, then 1/d at two decimals, halves rounded to even."""
    return F.when(distance_km <= 1, 1.0).otherwise(F.rint(F.try_divide(F.lit(100.0), distance_km)) / 100)


def distance_weighted_mean(hourly: DataFrame, keys: list[str] = SERIES, value: str = "value",
                           out: str = "observed") -> DataFrame:
    """Mean over the sensors that have a value at that hour, weighted by distance."""
    weighted = hourly.withColumn("_w", distance_weight(F.col("distance_km")))
    # beyond 200 km a weight rounds to 0: a sensor on its own still gives its value
    alone = F.min("sensor_id") == F.max("sensor_id")
    mean = F.coalesce(weighted_avg(F.col(value), F.col("_w")), F.when(alone, F.avg(value)))
    return weighted.groupBy(*keys, "time").agg(mean.alias(out))


def sensor_mean(hourly: DataFrame, keys: list[str] = SERIES, value: str = "value") -> DataFrame:
    return hourly.groupBy(*keys, "time").agg(F.avg(value).alias(value))


def quartile_bounds(df: DataFrame, keys: list[str] = SERIES, value: str = "observed",
                    rate: float = 20, approximate: bool = False) -> DataFrame:
    """``q1, q3, iqr, threshold`` per series; exact unless ``approximate``."""
    if approximate:
        bounds = df.groupBy(*keys).agg(F.percentile_approx(value, 0.25).alias("q1"),
                                       F.percentile_approx(value, 0.75).alias("q3"))
    else:
        bounds = exact_quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return bounds.withColumns({"iqr": iqr, "threshold": F.col("q3") + rate * iqr})


def iqr_outlier_filter(df: DataFrame, keys: list[str] = SERIES, value: str = "observed",
                       rate: float = 20, approximate: bool = False) -> DataFrame:
    """Keep values strictly below q3 + rate * iqr. A constant series loses every row."""
    bounds = quartile_bounds(df, keys, value, rate, approximate).select(*keys, "threshold")
    return df.join(bounds, keys).where(F.col(value) < F.col("threshold")).drop("threshold")


def _fill(knots: DataFrame, keys: list[str], fields: list[str], max_gap_hours: int | None) -> DataFrame:
    """Rows ``time, next_time, f, next_f ..`` to hourly rows, linear between the two."""
    limit = "true" if max_gap_hours is None else f"_gap <= {max_gap_hours}"
    between = [f"if(_step = 0, {f}, {f} + (next_{f} - {f}) * _step / _gap) AS {f}" for f in fields]
    return (knots
            .withColumn("_gap", F.expr("(unix_timestamp(next_time) - unix_timestamp(time)) div 3600"))
            .withColumn("_step", F.expr(f"explode(sequence(0L, if({limit} AND _gap > 1, _gap - 1, 0L)))"))
            .selectExpr(*keys, "timestamp_seconds(unix_timestamp(time) + _step * 3600) AS time", *between))


def upsample_linear(df: DataFrame, fields: list[str], keys: list[str] = ["location_id"]) -> DataFrame:
    """Hourly rows from the first to the last knot of each series, linear in between, any gap."""
    return _fill(with_next(df.select(*keys, "time", *fields), keys, fields), keys, fields, None)


def interpolate_gaps(df: DataFrame, keys: list[str] = SERIES, value: str = "observed",
                     max_gap_hours: int = 12) -> DataFrame:
    """Fill hours between valid rows at most ``max_gap_hours`` apart; longer gaps stay empty."""
    known = spread(df.where(F.col(value).isNotNull()).select(*keys, "time", value), ahead=max_gap_hours)
    following = f"OVER (PARTITION BY {', '.join(keys)}, _chunk ORDER BY time)"
    known = own_rows(known.selectExpr("*", f"lead(time) {following} AS next_time",
                                      f"lead({value}) {following} AS next_{value}"))
    return _fill(known, keys, [value], max_gap_hours)


def differentiate_accumulated(df: DataFrame, fields: list[str] = ACCUMULATED, keys: list[str] = ["location_id"],
                              reset_aware: bool = False) -> DataFrame:
    """Hourly rate of accumulated fields on a gap-free hourly table: central inside, one-sided at the ends.

    Negative or missing rates become 0. ``reset_aware`` differences within each UTC day, so the
    daily restart of the accumulation costs nothing.
    """
    part = "_day" if reset_aware else "_chunk"
    rows = df.withColumn("_day", F.to_date("time")) if reset_aware else spread(df, back=1, ahead=1)
    series = f"OVER (PARTITION BY {', '.join([*keys, part])} ORDER BY time)"

    def rate(field: str) -> str:
        before, after = f"lag({field}) {series}", f"lead({field}) {series}"
        first, final = f"lag(time) {series} IS NULL", f"lead(time) {series} IS NULL"
        slope = (f"CASE WHEN {first} AND {final} THEN 0D WHEN {first} THEN {after} - {field} "
                 f"WHEN {final} THEN {field} - {before} ELSE ({after} - {before}) / 2 END")
        return f"greatest(coalesce({slope}, 0D), 0D) AS {field}"

    rows = rows.selectExpr(*[c for c in rows.columns if c not in fields], *[rate(f) for f in fields])
    return (rows if reset_aware else own_rows(rows)).select(*df.columns)


def negative_to_null(df: DataFrame, value: str = "observed") -> DataFrame:
    return df.withColumn(value, F.when(F.col(value) >= 0, F.col(value)))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null (or NaN) in any column."""
    return df.dropna("any")


def deseasonalise(df: DataFrame, fields: list[str], keys: list[str] = SERIES) -> DataFrame:
    """Each field less its mean for the calendar month. Means are joined back, not windowed."""
    rows = df.withColumn("_month", F.month("time"))
    means = rows.groupBy(*keys, "_month").agg(*[F.avg(f).alias(f"_mean_{f}") for f in fields])
    return (rows.join(means, [*keys, "_month"])
            .withColumns({f: F.col(f) - F.col(f"_mean_{f}") for f in fields}).select(*df.columns))


def period_start(time: Column, agg: str) -> Column:
    """Label of the daily (the day) or monthly (its last day) bin."""
    if agg == "daily":
        return F.date_trunc("day", time)
    if agg == "monthly":
        return F.last_day(time).cast("timestamp")
    raise KeyError(agg)


def resample_mean(df: DataFrame, agg: str, fields: list[str], keys: list[str] = SERIES) -> DataFrame:
    """Daily or monthly mean of every field; periods with a null mean are dropped."""
    return (df.groupBy(*keys, period_start(F.col("time"), agg).alias("time"))
            .agg(*[F.avg(f).alias(f) for f in fields]).dropna("any"))
