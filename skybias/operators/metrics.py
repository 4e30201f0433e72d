"""Scores of forecasts against observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skybias.functions.stats import pearson
from skybias.operators.validation import RUN
from skybias.schemas import FORECAST_TYPES, METRICS, SERIES, SERIES_LABELS
from skybias.session import measured

PERIOD = [*SERIES, "split"]
FOUR = ["cams", "observations", "corrected", "persistence"]
TYPES = {c: SERIES_LABELS[c] for c in FORECAST_TYPES}


def _error_means(errors: DataFrame, keys: list[str]) -> DataFrame:
    return errors.groupBy(*keys).agg(F.avg("_e").alias("_mean_e"))


def score(df: DataFrame, keys: list[str], actual: str, forecast: str, small_groups: bool = False) -> DataFrame:
    """NMAE, bias, RMSE, de-biased NMAE and correlation of ``forecast`` against ``actual`` per group.

    De-biasing needs the group's mean error first. ``small_groups`` promises groups of a fixed small
    size (the hours of one run): the mean then comes from a window that shares the aggregate's
    shuffle. Otherwise it is aggregated, stored and joined back, so that no group ends up in one task and rows are shuffled only for a
    table of means that is too large to broadcast.
    """
    f, o = F.col(forecast), F.col(actual)
    errors = df.select(*keys, f.alias("_f"), o.alias("_o"), (f - o).alias("_e")).where((f - o).isNotNull())
    if small_groups:
        errors = errors.withColumn("_mean_e", F.avg("_e").over(Window.partitionBy(*keys)))
    else:
        errors = errors.join(measured(_error_means(errors, keys), "means"), keys)
    e, mean_o = F.col("_e"), F.avg("_o")
    return errors.groupBy(*keys).agg(
        F.try_divide(F.avg(F.abs(e)), mean_o).alias("nmae"),
        F.avg(e).alias("bias"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.try_divide(F.avg(F.abs(e - F.col("_mean_e"))), mean_o).alias("debiased_nmae"),
        pearson(F.col("_f"), F.col("_o")).alias("pearson"))


def score_side_by_side(df: DataFrame, keys: list[str], actual: str, forecasts: dict[str, str], small_groups: bool = False) -> DataFrame:
    """What ``score`` gives for each of several forecasts, ``{column: type}``, with their ``type``: rows carry all of them and become one per type
    after they are summed. A type without an error in a group has no row."""
    def both(c: str) -> Column:
        return F.col(c) - F.col(actual)

    rows = df.select(*keys, actual, *forecasts)
    if small_groups:
        rows = rows.withColumns({f"_mean_{c}": F.avg(both(c)).over(Window.partitionBy(*keys)) for c in forecasts})
    else:
        rows = rows.join(measured(rows.groupBy(*keys).agg(*[F.avg(both(c)).alias(f"_mean_{c}") for c in forecasts]), "means"), keys)
    sums = []
    for c in forecasts:
        e, o = both(c), F.when(both(c).isNotNull(), F.col(actual))
        mean_o = F.avg(o)
        sums.append(F.when(F.count(e) > 0, F.struct(
            F.try_divide(F.avg(F.abs(e)), mean_o).alias("nmae"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"),
            F.try_divide(F.avg(F.abs(e - F.col(f"_mean_{c}"))), mean_o).alias("debiased_nmae"),
            pearson(F.when(both(c).isNotNull(), F.col(c)), o).alias("pearson"))).alias(f"_{c}"))
    pairs = ", ".join(f"'{label}', _{c}" for c, label in forecasts.items())
    long = rows.groupBy(*keys).agg(*sums).selectExpr(*keys, f"stack({len(forecasts)}, {pairs}) AS (type, _scores)")
    return long.where("_scores IS NOT NULL").select(*keys, "type", "_scores.*")


def by_type(validation: DataFrame) -> DataFrame:
    """One row per forecast type: raw, corrected, persistence."""
    pairs = ", ".join(f"'{SERIES_LABELS[c]}', {c}" for c in FORECAST_TYPES)
    others = [c for c in validation.columns if c not in FORECAST_TYPES]
    return validation.selectExpr(*others, f"stack({len(FORECAST_TYPES)}, {pairs}) AS (type, forecast)")


def score_runs(validation: DataFrame) -> DataFrame:
    """The five metrics of each run (24 hours) and type."""
    return score_side_by_side(validation, RUN, "observations", TYPES, small_groups=True)


def score_runs_mean(runs: DataFrame) -> DataFrame:
    """Run scores plus one row per type, ``run = 'Mean'``: the unweighted mean over runs, per split."""
    runs = measured(runs, "runs")  # read for the means and again for the rows
    means = runs.groupBy(*PERIOD, "type").agg(*[F.avg(m).alias(m) for m in METRICS])
    labelled = runs.withColumn("run", F.date_format("init_time", "yyyy-MM-dd HH:mm:ss")).drop("init_time")
    return labelled.unionByName(means.withColumn("run", F.lit("Mean")))


def resample_validation(validation: DataFrame) -> DataFrame:
    """Mean of the four series in bins of eleven resolutions, in one pass.

    Bins of fixed length start at midnight of the first day of the (location, variable, split)
    series, not at the epoch.
    """
    origins = validation.groupBy(*PERIOD).agg(F.expr("unix_timestamp(date_trunc('day', min(time)))").alias("_o"))

    def fixed(label: str, hours: int) -> str:
        size = hours * 3600
        return f"struct('{label}' AS resampling, _o + floor((_t - _o) / {size}) * {size} AS bin, 0L AS run)"

    sizes = {"H": 1, "3H": 3, "6H": 6, "12H": 12, "D": 24, "3D": 72, "7D": 168, "15D": 360}
    calendar = [f"struct('{label}' AS resampling, unix_timestamp(date_trunc('{unit}', time)) AS bin, 0L AS run)"
                for label, unit in (("MS", "month"), ("QS", "quarter"))]
    as_is = "struct('No Resampling' AS resampling, _t AS bin, unix_timestamp(init_time) AS run)"
    bins = ", ".join([fixed(k, v) for k, v in sizes.items()] + calendar + [as_is])
    return (validation.join(origins, PERIOD).withColumn("_t", F.unix_timestamp("time"))
            .selectExpr(*PERIOD, *FOUR, f"inline(array({bins}))")
            .groupBy(*PERIOD, "resampling", "bin", "run").agg(*[F.avg(c).alias(c) for c in FOUR])
            .dropna("any", subset=FOUR)
            .withColumn("bin", F.timestamp_seconds("bin")))


def score_series(validation: DataFrame) -> DataFrame:
    """The five metrics of the whole series per split, resolution and type."""
    # read for the mean errors and again for the scores
    resampled = measured(resample_validation(validation).select(*PERIOD, "resampling", *FOUR), "resampled")
    return score_side_by_side(resampled, [*PERIOD, "resampling"], "observations", TYPES)


def regression_metrics(df: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction",
                       digits: int | None = 3) -> DataFrame:
    """Explained variance, largest error, MAE, RMSE, R2: per horizon, then the plain mean over horizons."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    present = df.where(e.isNotNull())
    per_horizon = present.groupBy(*keys, "horizon").agg(
        (1 - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("explained_variance"),
        F.max(F.abs(e)).alias("max_error"),
        F.avg(F.abs(e)).alias("mean_absolute_error"),
        F.sqrt(F.avg(e * e)).alias("root_mean_squared_error"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"))
    names = [c for c in per_horizon.columns if c not in [*keys, "horizon"]]
    out = per_horizon.groupBy(*keys).agg(*[(F.max(c) if c == "max_error" else F.avg(c)).alias(c) for c in names])
    return round_metrics(out, names, digits)


def round_metrics(df: DataFrame, names: list[str], digits: int | None) -> DataFrame:
    return df if digits is None else df.withColumns({c: F.bround(c, digits) for c in names})


def baseline_metrics(df: DataFrame, keys: list[str], label: str = "label", digits: int | None = 3) -> DataFrame:
    """The raw forecast as a model: its error is the bias itself. Horizons are rounded one digit finer."""
    y, names = F.col(label), ["max_error", "mean_absolute_error", "root_mean_squared_error"]
    per_horizon = df.groupBy(*keys, "horizon").agg(
        F.max(F.abs(y)).alias(names[0]), F.avg(F.abs(y)).alias(names[1]), F.sqrt(F.avg(y * y)).alias(names[2]))
    per_horizon = round_metrics(per_horizon, names, None if digits is None else digits + 1)
    out = per_horizon.groupBy(*keys).agg(F.max(names[0]).alias(names[0]), *[F.avg(c).alias(c) for c in names[1:]])
    return round_metrics(out, names, digits)


def acceptance_gate(cams_mae: Column, train_mae: Column, test_mae: Column) -> Column:
    """False where the model beats 80 % of the raw forecast's error on neither split."""
    bar = cams_mae * 0.8
    return ~((bar < train_mae) & (bar < test_mae))
