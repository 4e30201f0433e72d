"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skybias.session import measured

COARSE, FINE = 16, 1 << 16


def _coarse(v: Column) -> Column:
    """Number of a wide bin: about 1/16 of a value's size, and evenly around zero. It never falls as ``v`` grows."""
    size = F.floor(F.log1p(F.abs(v) * 1e6) * COARSE)
    return F.when(F.isnan(v), F.lit(1 << 62)).when(F.abs(v) == float("inf"), F.signum(v) * (1 << 61)).otherwise(F.when(v < 0, -size).otherwise(size)).cast("long")


def _fine(v: Column) -> Column:
    """Number of a narrow bin among ``FINE`` even ones between the smallest and largest value of a wide bin."""
    low, high = F.col("_lo"), F.col("_hi")
    return F.when(high > low, F.least(F.floor((v - low) / (high - low) * FINE), F.lit(FINE - 1))).otherwise(0).cast("long")


def _found(histogram: DataFrame, keys: list[str], bin_: str) -> DataFrame:
    """Bins that hold a wanted rank, with the ranks (``_want``) counted from the bin's first row."""
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.filter("_want", lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_before") + F.col("_c")))
    return (histogram.withColumn("_before", before).withColumn("_want", inside).where(F.size("_want") > 0)
            .withColumn("_want", F.transform("_want", lambda w: F.struct(w["target"].alias("target"), (w["rank"] - F.col("_before")).alias("rank"))))
            .drop("_before", "_c"))


def quantile_boxes(df: DataFrame, keys: list[str], values: list[str], probs: dict[str, float]) -> DataFrame:
    """One row per group and column of ``values`` (``_i``, its place) with the linearly interpolated quantiles ``{column: probability}``.

    A quantile lies between two ranks. Counts of wide bins, combined map-side, tell which bin holds a rank; counts of narrow bins inside it leave
    about a millionth of the group's values, whose different ones are counted and ranked. No task holds more of a group than its bins and these.
    Groups of all sizes go the same way. The wide bins that hold a rank are stored: at most two for each quantile and column, so rows meet them
    side by side, and only values inside them become rows of their own. Groups with a null key, and columns without a value, have no row; nulls are no values.
    """
    numbers = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(values)]
    wide_rows = df.select(*keys, *numbers)
    pairs = ", ".join(f"{i}, _v{i}" for i in range(len(values)))
    group = [*keys, "_i"]
    rows = wide_rows.selectExpr(*keys, f"stack({len(values)}, {pairs}) AS (_i, _v)").where(F.col("_v").isNotNull()).withColumn("_b1", _coarse(F.col("_v")))
    wide = rows.groupBy(*group, "_b1").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wide = wide.withColumn("_n", F.sum("_c").over(Window.partitionBy(*group)))
    place = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in probs.items()}
    targets = [F.struct(F.lit(2 * i + up).alias("target"), F.least(F.floor(p).cast("long") + up, F.col("_n") - 1).alias("rank"))
               for i, p in enumerate(place.values()) for up in (0, 1)]
    one = measured(_found(wide.withColumn("_want", F.array(*targets)), group, "_b1"), "bins")
    # all bins of a group, which its rows meet once
    bins = one.groupBy(*keys).agg(F.collect_list(F.struct("_i", "_b1", "_lo", "_hi")).alias("_bins"))
    numbered = F.array(*[_coarse(F.col(f"_v{i}")) for i in range(len(values))])
    inside = F.filter("_bins", lambda b: b["_b1"] == F.get("_at", b["_i"]))
    value = F.get(F.array(*[f"_v{i}" for i in range(len(values))]), F.col("_bin._i"))
    near = (wide_rows.join(bins, keys).withColumn("_at", numbered).withColumn("_bin", F.explode(inside))
            .select(*keys, "_bin.*", value.alias("_v")).withColumn("_b2", _fine(F.col("_v"))))
    # the different values of the wide bins, with their counts, shuffled once for both of the following
    values_ = near.groupBy(*group, "_b1", "_b2", "_v").agg(F.count(F.lit(1)).alias("_c"))
    narrow = values_.groupBy(*group, "_b1", "_b2").agg(F.sum("_c").alias("_c")).join(one.select(*group, "_b1", "_n", "_want"), [*group, "_b1"])
    two = _found(narrow, [*group, "_b1"], "_b2")
    last = values_.join(two, [*group, "_b1", "_b2"])
    three = _found(last, [*group, "_b1", "_b2"], "_v").select(*group, "_n", "_v", F.explode("_want.target").alias("_target"))
    out = []
    for i, (name, p) in enumerate(place.items()):
        low, high = (F.max(F.when(F.col("_target") == 2 * i + up, F.col("_v"))) for up in (0, 1))
        share = F.max(p - F.floor(p))
        out.append(F.when(share == 0, low).otherwise(low * (1 - share) + high * share).alias(name))
    return three.groupBy(*group).agg(*out)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with the linearly interpolated quantiles ``{column: probability}`` of ``value``."""
    return quantile_boxes(df, keys, [value], probs).drop("_i")
