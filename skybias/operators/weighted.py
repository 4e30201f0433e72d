"""Weighted statistics; ``keys`` are the dimensions that are kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skybias.functions.stats import mask, pearson


def _weighted(x: Column, w: Column) -> Column:
    total = F.sum(w)
    bad = total.isNull() | (total == 0)
    ratio = F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))
    return F.when(bad, F.raise_error(F.lit("weights do not add up to 1")).cast("double")).otherwise(ratio)


def weighted_mean(df: DataFrame, keys: list[str], columns: list[str], weight: str | None = None,
                  dims: list[str] | None = None) -> DataFrame:
    """Mean of each column; ``sum(x*w) / sum(w where x is present)`` with weights.

    With weights and a reduced dimension the table does not have, the table comes back unchanged.
    """
    if weight is None:
        return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])
    if dims is not None and not set(dims) <= set(df.columns):
        return df
    return df.groupBy(*keys).agg(*[_weighted(F.col(c), F.col(weight)).alias(c) for c in columns])


def weighted_rmsd(df: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    d = F.col(x) - F.col(y)
    return df.groupBy(*keys).agg(F.sqrt(_weighted(d * d, F.col(weight))).alias("rmsd"))


def plain_errors(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Unweighted ``mse``, ``rmse`` and ``pearson``."""
    d = F.col(x) - F.col(y)
    return df.groupBy(*keys).agg(F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"),
                                 pearson(F.col(x), F.col(y)).alias("pearson"))


def _deviations(df: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    means = df.groupBy(*keys).agg(_weighted(F.col(x), F.col(weight)).alias("_mx"),
                                  _weighted(F.col(y), F.col(weight)).alias("_my"))
    return (df.join(means, keys)
            .select(*keys, weight, (F.col(x) - F.col("_mx")).alias("_dx"), (F.col(y) - F.col("_my")).alias("_dy")))


def weighted_cov(df: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted mean of the products of deviations from the weighted means."""
    return _deviations(df, keys, x, y, weight).groupBy(*keys).agg(
        _weighted(F.col("_dx") * F.col("_dy"), F.col(weight)).alias("cov"))


def weighted_corr(df: DataFrame, keys: list[str], x: str, y: str, weight: str, return_p: bool = True) -> DataFrame:
    """Weighted correlation ``r`` over the rows where both are present, its pair count ``n``, and ``p``."""
    both = df.withColumns({x: mask(F.col(x), F.col(y)), y: mask(F.col(y), F.col(x))})
    dx, dy, w = F.col("_dx"), F.col("_dy"), F.col(weight)
    spread = F.sqrt(_weighted(dx * dx, w) * _weighted(dy * dy, w))
    out = _deviations(both, keys, x, y, weight).groupBy(*keys).agg(
        F.try_divide(_weighted(dx * dy, w), spread).alias("r"), F.count("_dx").alias("n"))
    return out.withColumn("p", correlation_p_value("r", "n")) if return_p else out


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument above 10."""
    shift = np.zeros_like(z)
    z = z.copy()
    while np.any(z < 10):
        low = z < 10
        shift[low] += np.log(z[low])
        z[low] += 1
    inverse = 1 / z
    series = inverse / 12 - inverse**3 / 360 + inverse**5 / 1260 - inverse**7 / 1680
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the beta function. Gammas of large arguments would cancel: their ratio has a series of its own."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    ratio = low * np.log(high) + low * (low - 1) / (2 * high) - low * (low - 1) * (2 * low - 1) / (12 * high**2)
    return _log_gamma(low) - np.where((high > 1e5) & (low < 10), ratio, _log_gamma(high + low) - _log_gamma(high))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300, y: np.ndarray | None = None) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (Lentz), elementwise; ``y`` is 1 - x where that is known better."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    y = 1 - x if y is None else np.asarray(y, dtype=float)
    swap = x > (a + 1) / (a + b + 2)
    p, q, t, rest = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, y, x), np.where(swap, x, y)
    with np.errstate(divide="ignore", invalid="ignore"):
        # the logarithm of the part near 1 comes from the other
        log_t = np.where(t > 0.5, np.log1p(-rest), np.log(t))
        log_rest = np.where(rest > 0.5, np.log1p(-t), np.log(rest))
        front = np.exp(p * log_t + q * log_rest - _log_beta(p, q)) / p
    tiny = 1e-300
    d = 1 - (p + q) * t / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, value = np.ones_like(t), d.copy()
    for m in range(1, rounds):
        for term in (m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)),
                     -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            value = value * d * c
    result = np.where(t <= 0, 0.0, front * value)
    return np.where(swap, 1 - result, result)


def _p_values(r: pd.Series, n: pd.Series) -> pd.Series:
    dof = n.to_numpy(dtype=float) - 2
    r = r.to_numpy(dtype=float)
    known = np.isfinite(r) & (dof > 0)
    # dof / (dof + t^2) with t^2 = r^2 dof / ((1 - r)(1 + r)) is 1 - r^2
    x = np.clip((1 - np.where(known, r, 0.0)) * (1 + np.where(known, r, 0.0)), 0.0, 1.0)
    a = np.where(known, dof, 1.0) / 2
    p = incomplete_beta(a, np.full_like(a, 0.5), x, y=np.where(known, r, 0.0)**2)
    return pd.Series(p).where(known, None)


def correlation_p_value(r: str, n: str) -> Column:
    """Two-sided p of a correlation of ``n`` pairs. Runs on aggregated rows only."""
    return F.pandas_udf(_p_values, "double")(F.col(r).cast("double"), F.col(n).cast("double"))
