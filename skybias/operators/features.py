"""Sliding windows, labels, splits and scaling for the bias models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skybias.functions.timeparts import lag_label, local_hour, time_features
from skybias.operators.chunks import CHUNK_HOURS, spread, with_rank
from skybias.schemas import FIELDS, SERIES
from skybias.session import measured

BLOCK_HOURS = 12
STATION_ATTRS = ["latitude_attr", "longitude_attr", "elevation_attr"]
TIME_AUX = ["hour_cos_aux", "hour_sin_aux", "month_cos_aux", "month_sin_aux"]
WINDOW_FIELDS = [f"{f}_forecast" for f in FIELDS] + ["observed", "bias"]


def min_station_rows(df: DataFrame, min_rows: int, keys: list[str] = SERIES) -> DataFrame:
    """Only series with at least ``min_rows`` hourly rows."""
    enough = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows)
    return df.join(measured(enough.select(*keys), "enough"), keys, "left_semi")


def packed_hours(df: DataFrame, n_prev: int, n_future: int, fields: list[str] = WINDOW_FIELDS, keys: list[str] = SERIES) -> DataFrame:
    """One row per series and time chunk: every field as an array in time order, and where in it the windows start (``_starts``).

    An hour is in one row, or two near the edge of a chunk, while it is in four windows of 48 hours: this is what to store of a dataset.
    Rows are shuffled once, by series and chunk.
    """
    size = n_prev + n_future
    rows = (spread(df.select(*keys, "time", *fields), ahead=max(0, size - BLOCK_HOURS))
            .withColumn("_hour", F.expr("unix_timestamp(time) div 3600"))
            .repartition(*keys, "_chunk"))
    packed = rows.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(F.struct("_hour", *fields))).alias("_rows"))
    # a window starts with a half day of this chunk, and is whole if as many hours as it should have lie between its first and its last
    starts = (f"filter(transform(_hours, (h, i) -> struct(h - pmod(h, {BLOCK_HOURS}) AS hour, i AS before)), w -> (w.before = 0 OR get(_hours, w.before - 1) < w.hour) "
              f"AND get(_hours, w.before + {size - 1}) < w.hour + {size} AND coalesce(get(_hours, w.before + {size}) >= w.hour + {size}, true) "
              f"AND w.hour - pmod(w.hour, {CHUNK_HOURS}) = _chunk * {CHUNK_HOURS})")
    return (packed.selectExpr(*keys, "_chunk", "_rows._hour AS _hours", *[f"_rows.{f} AS {f}" for f in fields])
            .selectExpr(*keys, f"{starts} AS _starts", *fields).where(F.size("_starts") > 0))


def _cut_out(packed: DataFrame, n_prev: int, parts: list[tuple[str, str, int, int]], fields: list[str], *more: str) -> DataFrame:
    """A row for each window: ``init_time``, expressions on it, and of each of ``parts`` (name, field, first hour, hours) a slice of the packed hours.
    The slices of a row are cut before it becomes many, so its arrays are not handed on with each."""
    init = f"timestamp_seconds((w.hour + {n_prev}) * 3600)"
    cut = [f"{init} AS init_time", *[m.replace("init_time", init, 1) for m in more], *[f"slice({f}, w.before + {at + 1}, {n}) AS {name}" for name, f, at, n in parts]]
    return packed.selectExpr(*[c for c in packed.columns if c not in [*fields, "_starts"]], f"inline(transform(_starts, w -> struct({', '.join(cut)})))")


def unpacked(packed: DataFrame, n_prev: int, n_future: int, fields: list[str] = WINDOW_FIELDS) -> DataFrame:
    """The windows of packed hours: slices of their arrays, made in the task that reads them."""
    return _cut_out(packed, n_prev, [(f, f, 0, n_prev + n_future) for f in fields], fields)


def sliding_samples(df: DataFrame, n_prev: int, n_future: int, fields: list[str] = WINDOW_FIELDS,
                    keys: list[str] = SERIES) -> DataFrame:
    """One row per window of ``n_prev + n_future`` gap-free hours that starts at 00 or 12 UTC.

    ``init_time`` is the first future hour; every field is an array in time order. Rows are shuffled
    once, by series and time chunk; windows are slices of the packed hours.
    """
    return unpacked(packed_hours(df, n_prev, n_future, fields, keys), n_prev, n_future, fields)


def _places(locations: DataFrame) -> DataFrame:
    return locations.select("location_id", "timezone", F.col("latitude").alias("latitude_attr"),
                            F.col("longitude").alias("longitude_attr"), F.col("elevation").alias("elevation_attr"))


def attach_attributes(samples: DataFrame, locations: DataFrame, numeric: bool = True) -> DataFrame:
    """Station coordinates and elevation, and the time features of the first forecast hour."""
    init = F.col("init_time")
    return (samples.join(_places(locations), "location_id")
            .select("*", *time_features(local_hour(init, F.col("timezone")), init, numeric)).drop("timezone"))


def _parts(n_prev: int, n_future: int, fields: list[str]) -> list[tuple[str, str, int, int]]:
    """(name, field, first hour, hours) of features and label. The observation of the future hours is in neither: it would give the label away."""
    future = [f for f in fields if f not in ("observed", "bias")]
    return [*[(f"past_{f}", f, 0, n_prev) for f in fields], *[(f"future_{f}", f, n_prev, n_future) for f in future], ("label", "bias", n_prev, n_future)]


def split_features_labels(samples: DataFrame, n_prev: int, n_future: int,
                          fields: list[str] = WINDOW_FIELDS) -> DataFrame:
    """Past block of every field, future block of the forecast fields, future bias as the label."""
    others = [c for c in samples.columns if c not in fields]
    return samples.selectExpr(*others, *[f"slice({f}, {at + 1}, {n}) AS {name}" for name, f, at, n in _parts(n_prev, n_future, fields)])


def split_times(times: DataFrame, ratio: float = 0.8, time: str = "init_time", keys: list[str] = SERIES) -> DataFrame:
    """(keys, ``_cut``): the last of the first ``floor(n * ratio)`` times of each series; null where there is none."""
    ranked = with_rank(times.select(*keys, time), keys, time)
    return ranked.groupBy(*keys).agg(F.expr(f"max(if(_rank <= floor(_total * {ratio}D), {time}, NULL))").alias("_cut"))


def train_test_split(df: DataFrame, ratio: float = 0.8, time: str = "init_time", keys: list[str] = SERIES) -> DataFrame:
    """Add ``split``: the first ``floor(n * ratio)`` rows of each series by time are train, the rest test; times of a series are distinct.

    Only keys are sorted; the rows meet one cut time per series.
    """
    return df.join(split_times(df, ratio, time, keys), keys).withColumn("split", F.expr(f"if({time} <= _cut, 'train', 'test')")).drop("_cut")


def window_times(df: DataFrame, n_prev: int, n_future: int, keys: list[str] = SERIES) -> DataFrame:
    """(keys, ``init_time``) of the windows that ``sliding_samples`` makes, from counts of hours in half days."""
    size = n_prev + n_future
    full, rest = divmod(size, BLOCK_HOURS)
    hour = "unix_timestamp(time) div 3600"
    halves = df.select(*keys, F.expr(f"floor({hour} / {BLOCK_HOURS})").alias("_block"), F.expr(f"pmod({hour}, {BLOCK_HOURS})").alias("_in")).groupBy(*keys, "_block").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_in") < rest).alias("_some"))
    halves = spread(halves.withColumn("time", F.expr(f"timestamp_seconds(_block * {BLOCK_HOURS * 3600})")), ahead=max(0, size - BLOCK_HOURS))
    names, whole = ", ".join(keys), []
    for i in range(full + (rest > 0)):
        count, want = ("_all", BLOCK_HOURS) if i < full else ("_some", rest)
        ahead = f"lead({count}, {i}) OVER (PARTITION BY {names}, _chunk ORDER BY _block)"
        place = f"lead(_block, {i}) OVER (PARTITION BY {names}, _chunk ORDER BY _block)"
        whole.append(f"coalesce({ahead} = {want} AND {place} = _block + {i}, false)")
    return (halves.selectExpr(*keys, "_block", "_chunk", "_own", f"{' AND '.join(whole)} AS _whole").where("_whole AND _chunk = _own")
            .selectExpr(*keys, f"timestamp_seconds((_block * {BLOCK_HOURS} + {n_prev}) * 3600) AS init_time"))


def packed_dataset(processed: DataFrame, n_prev: int = 24, n_future: int = 24, min_rows: int | None = None, ratio: float = 0.8,
                   fields: list[str] = WINDOW_FIELDS) -> DataFrame:
    """The hours that the samples of all stations are slices of, with the cut time of each series: a dataset as it is stored.

    The split is known before the windows are made: cut times come from counts of hours, are stored and meet the hourly rows.
    """
    enough = min_station_rows(processed.select(*SERIES, "time"), min_rows or n_prev + n_future)
    cuts = measured(split_times(window_times(enough, n_prev, n_future), ratio), "cuts")
    return packed_hours(processed.join(cuts, SERIES), n_prev, n_future, [*fields, "_cut"])


def unpacked_dataset(packed: DataFrame, locations: DataFrame, n_prev: int = 24, n_future: int = 24, numeric: bool = True,
                     fields: list[str] = WINDOW_FIELDS) -> DataFrame:
    """Samples with features, label, attributes and split from what ``packed_dataset`` returned, without a shuffle."""
    # places meet the packed hours, which are a fraction of the windows
    placed = packed.join(_places(locations), "location_id")
    samples = _cut_out(placed, n_prev, _parts(n_prev, n_future, fields), [*fields, "_cut"], "if(init_time <= _cut[0], 'train', 'test') AS split")
    init, last = F.col("init_time"), [*STATION_ATTRS, "timezone"]
    return samples.select(*[c for c in samples.columns if c not in last], *STATION_ATTRS, *time_features(local_hour(init, F.col("timezone")), init, numeric))


def build_dataset(processed: DataFrame, locations: DataFrame, n_prev: int = 24, n_future: int = 24,
                  min_rows: int | None = None, ratio: float = 0.8, numeric: bool = True,
                  fields: list[str] = WINDOW_FIELDS) -> DataFrame:
    """Samples of all stations with features, label, attributes and split, in one plan; window arrays are not shuffled."""
    packed = packed_dataset(processed, n_prev, n_future, min_rows, ratio, fields)
    return unpacked_dataset(packed, locations, n_prev, n_future, numeric, fields)


def shuffle_rows(df: DataFrame, seed: int = 0, keys: list[str] = [*SERIES, "init_time"]) -> DataFrame:
    """Rows in a random order that depends on ``seed`` and the rows' keys alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def _fit_stats(train: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation per column and variable; a zero deviation counts as 1. Stored, so that no row is shuffled to meet them."""
    stats = train.groupBy("variable").agg(
        *[F.expr(f"avg({c})").alias(f"_m_{c}") for c in columns],
        *[F.expr(f"coalesce(nullif(stddev_pop({c}), 0D), 1D)").alias(f"_s_{c}") for c in columns])
    return measured(stats, "scales")


def scale_attributes(dataset: DataFrame, columns: list[str] = STATION_ATTRS) -> DataFrame:
    """Standardise station attributes with the training rows' statistics."""
    stats = _fit_stats(dataset.where("split = 'train'"), columns)
    scaled = [f"({c} - _m_{c}) / _s_{c} AS {c}" if c in columns else c for c in dataset.columns]
    return dataset.join(stats, "variable").selectExpr(*scaled)


def scale_series(dataset: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Standardise window fields: statistics over all past steps of the training rows, also used on the future."""
    fields = fields or [c[len("past_"):] for c in dataset.columns if c.startswith("past_")]
    steps = F.expr(f"inline(arrays_zip({', '.join(f'past_{f}' for f in fields)}))")
    stats = _fit_stats(dataset.where("split = 'train'").select("variable", steps), [f"past_{f}" for f in fields])

    def scaled(column: str) -> str:
        field = column.removeprefix("past_").removeprefix("future_")
        if field not in fields or column == field:
            return column
        return f"transform({column}, x -> (x - _m_past_{field}) / _s_past_{field}) AS {column}"

    return dataset.join(stats, "variable").selectExpr(*[scaled(c) for c in dataset.columns])


def to_parity_wide(samples: DataFrame, n_prev: int, n_future: int, fields: list[str]) -> DataFrame:
    """Window arrays as one column per field and lag: ``bias_-24 .. bias_-01, bias_00 .. bias_23``."""
    others = [c for c in samples.columns if c not in fields]
    wide = [f"{f}[{i}] AS `{f}_{lag_label(i, n_prev)}`" for f in fields for i in range(n_prev + n_future)]
    return samples.selectExpr(*others, *wide)
