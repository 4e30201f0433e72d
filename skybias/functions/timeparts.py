"""Local hour, cyclic time features, labels and slugs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_hour(time: Column, timezone: Column) -> Column:
    """Hour of the day on the station's clock."""
    return F.hour(F.from_utc_timestamp(time, timezone))


def cyclic(part: Column, period: int, name: str) -> list[Column]:
    angle = part * (2 * math.pi / period)
    return [F.cos(angle).alias(f"{name}_cos_aux"), F.sin(angle).alias(f"{name}_sin_aux")]


def time_features(local_time_hour: Column, time: Column, numeric: bool = True) -> list[Column]:
    """Cosine and sine of local hour and UTC month, or the bare hour and month."""
    month = F.month(time)
    if numeric:
        return cyclic(local_time_hour, 24, "hour") + cyclic(month, 12, "month")
    return [local_time_hour.alias("hour"), month.alias("month")]


def time_part(time: Column, unit: str) -> Column:
    parts = {"hour": F.hour, "month": F.month}
    if unit not in parts:
        raise NotImplementedError("the unit must be 'hour' or 'month'")
    return parts[unit](time)


def lag_label(step: int, n_prev: int) -> str:
    """Name of window step 0..n-1: -24 .. -01 for the past, 00 .. 23 for the future."""
    lag = step - n_prev
    return f"-{-lag:02d}" if lag < 0 else f"{lag:02d}"


def lead_label(lead: Column) -> Column:
    return F.lpad(lead.cast("string"), 3, "0")


def slug(text: Column, space: str = "-") -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit(space))


def epoch_hours(time: Column) -> Column:
    """Whole hours since the epoch (floored)."""
    return F.floor(F.unix_timestamp(time) / 3600).cast("long")


def from_epoch_hours(hours: Column) -> Column:
    return F.timestamp_seconds(hours * 3600)


def shift_hours(time: Column, hours: int | Column) -> Column:
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return F.timestamp_seconds(F.unix_timestamp(time) + hours * 3600)
