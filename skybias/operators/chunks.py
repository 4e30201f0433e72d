"""Window helpers that never put a whole series into one task.

A series (one location and variable) may hold any share of the rows, so ordered operators work on
chunks of calendar time: a task holds one chunk of one series, at most ``hours`` hourly rows plus a
margin. What must cross a chunk's edge is either copied (``spread``, where the reach is bounded) or
looked up in a table with one row per chunk (``with_next``, ``with_rank``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_HOURS = 720


def _chunk_at(seconds: Column, hours: int) -> Column:
    return F.floor(seconds / (hours * 3600)).cast("long")


def spread(df: DataFrame, time: str = "time", hours: int = CHUNK_HOURS,
           back: int = 0, ahead: int = 0) -> DataFrame:
    """Put each row into its own chunk and into those chunks that look ``back`` or ``ahead`` at it.

    Adds ``_chunk`` and ``_own``; rows with ``_chunk != _own`` are margin and must be dropped after
    the window has used them.
    """
    seconds = F.unix_timestamp(time)
    first, last = _chunk_at(seconds - ahead * 3600, hours), _chunk_at(seconds + back * 3600, hours)
    return (df.withColumn("_own", _chunk_at(seconds, hours))
              .withColumn("_chunk", F.explode(F.sequence(first, last))))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_chunk = _own").drop("_chunk", "_own")


def with_next(df: DataFrame, keys: list[str], cols: list[str], time: str = "time",
              hours: int = CHUNK_HOURS) -> DataFrame:
    """Add ``next_<c>`` for the time and each of ``cols``: the following row of the series, however far."""
    chunked = df.withColumn("_chunk", _chunk_at(F.unix_timestamp(time), hours))
    wanted, names = [time, *cols], ", ".join(keys)
    heads = chunked.groupBy(*keys, "_chunk").agg(
        *[F.expr(f"min_by({c}, {time})").alias(f"_head_{c}") for c in wanted])
    heads = heads.selectExpr(*keys, "_chunk", *[
        f"lead(_head_{c}) OVER (PARTITION BY {names} ORDER BY _chunk) AS _head_{c}" for c in wanted])
    rows = chunked.selectExpr("*", *[
        f"lead({c}) OVER (PARTITION BY {names}, _chunk ORDER BY {time}) AS _lead_{c}" for c in wanted])
    return rows.join(heads, [*keys, "_chunk"]).selectExpr(*df.columns, *[
        f"if(_lead_{time} IS NULL, _head_{c}, _lead_{c}) AS next_{c}" for c in wanted])


def with_rank(df: DataFrame, keys: list[str], time: str, hours: int = CHUNK_HOURS) -> DataFrame:
    """Add ``_rank`` (1-based position in the series by time) and ``_total`` (rows of the series)."""
    chunked = df.withColumn("_chunk", _chunk_at(F.unix_timestamp(time), hours))
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    series = Window.partitionBy(*keys)
    earlier = series.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                         F.sum("_n").over(series).alias("_total"))
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(time)
    return (chunked.withColumn("_rank", F.row_number().over(in_chunk))
            .join(sizes, [*keys, "_chunk"])
            .withColumn("_rank", F.col("_rank") + F.col("_before"))
            .drop("_chunk", "_before"))
