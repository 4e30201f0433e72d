"""Ensemble mean, corrected forecast and the table that scores compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skybias.functions.timeparts import shift_hours
from skybias.schemas import SERIES, SERIES_LABELS

RUN = [*SERIES, "split", "init_time"]


def ensemble_mean(predictions: DataFrame, members: int) -> DataFrame:
    """Mean of the members per run and horizon; null where a member is missing."""
    return (predictions.groupBy(*RUN, "horizon")
            .agg(F.when(F.count("bias_hat") == members, F.avg("bias_hat")).alias("bias_hat")))


def union_splits(train: DataFrame, test: DataFrame, which: str = "all") -> DataFrame:
    """Predictions of both splits, or of one, marked by ``split``."""
    parts = {"train": train.withColumn("split", F.lit("train")), "test": test.withColumn("split", F.lit("test"))}
    if which == "all":
        return parts["train"].unionByName(parts["test"])
    if which not in parts:
        raise NotImplementedError("choose 'train', 'test' or 'all'")
    return parts[which]


def horizon_unpivot(df: DataFrame, array: str, value: str = "bias_hat") -> DataFrame:
    """One row per horizon: element h (0-based) belongs to ``init_time + h`` hours."""
    others = [c for c in df.columns if c != array]
    return (df.select(*others, F.posexplode(array).alias("horizon", value))
            .withColumn("time", shift_hours(F.col("init_time"), F.col("horizon"))))


def persistence_24h(processed: DataFrame) -> DataFrame:
    """Add ``persistence``: the observation of the same hour one day earlier, null where there is none."""
    earlier = processed.select(*SERIES, shift_hours(F.col("time"), 24).alias("time"),
                               F.col("observed").alias("persistence"))
    return processed.join(earlier, [*SERIES, "time"], "left")


def correct_forecast(processed: DataFrame, bias_hat: DataFrame) -> DataFrame:
    """``corrected`` = forecast - predicted bias, at ``init_time + horizon``."""
    at = bias_hat.withColumn("time", shift_hours(F.col("init_time"), F.col("horizon")))
    return (at.join(processed, [*SERIES, "time"])
            .withColumn("corrected", F.col("forecast") - F.col("bias_hat")))


def validation_hours(processed: DataFrame, bias_hat: DataFrame) -> DataFrame:
    """Every hour of every run for which all four series exist."""
    series = persistence_24h(processed.select(*SERIES, "time", "forecast", "observed"))
    return (correct_forecast(series, bias_hat)
            .select(*RUN, "horizon", "time", F.col("forecast").alias("cams"), F.col("observed").alias("observations"),
                    "corrected", "persistence")
            .dropna("any"))


def build_validation(processed: DataFrame, bias_hat: DataFrame, n_future: int = 24, ranges: list[str] | None = None) -> DataFrame:
    """The four series of each run that has all of its ``n_future`` hours.

    With ``ranges``, columns of a run, the shuffle that counts its hours deals runs by ranges of them: what is stored by these needs no other.
    """
    run = Window.partitionBy(*RUN)  # at most n_future rows
    hours = validation_hours(processed, bias_hat)
    hours = hours.repartitionByRange(*ranges) if ranges else hours
    return hours.withColumn("_hours", F.count("*").over(run)).where(F.col("_hours") == n_future).drop("_hours")


def incomplete_runs(processed: DataFrame, bias_hat: DataFrame, n_future: int = 24) -> DataFrame:
    """Runs that ``build_validation`` leaves out, with the number of hours they do have."""
    wanted = bias_hat.select(*RUN).distinct()
    have = validation_hours(processed, bias_hat).groupBy(*RUN).agg(F.count("*").alias("hours"))
    return (wanted.join(have, RUN, "left").withColumn("hours", F.coalesce("hours", F.lit(0)))
            .where(F.col("hours") < n_future))


def stack_series(validation: DataFrame) -> DataFrame:
    """Wide to long: one row per series, with ``data_kind`` = "type - (split)"."""
    pairs = ", ".join(f"'{label}', {c}" for c, label in SERIES_LABELS.items())
    return (validation.selectExpr(*RUN, "time", f"stack({len(SERIES_LABELS)}, {pairs}) AS (data_type, value)")
            .withColumn("data_kind", F.concat("data_type", F.lit(" - ("), "split", F.lit(")"))))


def scatter_pairs(validation: DataFrame) -> DataFrame:
    """Observation against each of the other series."""
    labels = {c: label for c, label in SERIES_LABELS.items() if c != "observations"}
    pairs = ", ".join(f"'{label}', {c}" for c, label in labels.items())
    return validation.selectExpr(*RUN, "time", "observations", f"stack({len(labels)}, {pairs}) AS (data_type, value)")


def predictions_with_observations(corrected: DataFrame, hourly_observed: DataFrame) -> DataFrame:
    """Corrected series with the observed hourly mean beside it, null where not observed."""
    return corrected.join(hourly_observed, [*SERIES, "time"], "left")


def latest_init_forecast(samples: DataFrame, day: str) -> DataFrame:
    """The window whose forecast starts at ``day`` 00:00."""
    return samples.where(F.col("init_time") == F.lit(day).cast("timestamp"))
