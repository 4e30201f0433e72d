"""Radius join and nearest grid cell."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skybias.functions.geo import EARTH_RADIUS_KM, grid_longitude, haversine_km
from skybias.session import work_path

AXIS_BUCKETS = 4096


def sensors_within_radius(locations: DataFrame, sensors: DataFrame, km: float = 100.0) -> DataFrame:
    """Pairs of location and sensor at most ``km`` apart, with ``distance_km``.

    Equi-join on cells about ``km`` wide: a sensor lies in one cell, a location is copied to the
    cells its bounding box touches, and the great-circle distance decides. Sensor coordinates come
    out as ``y`` and ``x``, the location's as ``_y`` and ``_x``.
    """
    angle = km / EARTH_RADIUS_KM
    height = math.degrees(angle)
    columns = max(1, math.floor(360 / height))
    width = 360 / columns

    def band(latitude: Column) -> Column:
        return F.floor((latitude + 90) / height).cast("long")

    def column(longitude: Column) -> Column:
        return F.floor((longitude + 180) / width).cast("long")

    lat, lon = F.col("latitude"), F.col("longitude")
    ratio = F.try_divide(F.lit(math.sin(angle)), F.cos(F.radians(lat)))
    half_width = F.when(F.abs(lat) + height >= 90, 180.0).otherwise(
        F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
    touched = F.when(half_width >= 180, F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).otherwise(
        F.array_distinct(F.transform(F.sequence(column(lon - half_width), column(lon + half_width)),
                                     lambda c: F.pmod(c, F.lit(columns)))))
    wide = (locations
            .withColumn("_band", F.explode(F.sequence(band(lat - height), band(lat + height))))
            .withColumn("_column", F.explode(touched))
            .withColumnsRenamed({"latitude": "_y", "longitude": "_x"}))
    placed = (sensors
              .withColumn("_band", band(lat))
              .withColumn("_column", F.pmod(column(lon), F.lit(columns)))
              .withColumnsRenamed({"latitude": "y", "longitude": "x"}))
    return (wide.join(placed, ["_band", "_column"]).drop("_band", "_column")
            .withColumn("distance_km", haversine_km(F.col("_y"), F.col("_x"), F.col("y"), F.col("x")))
            .where(F.col("distance_km") <= km))


def grid_axes(grid: DataFrame) -> DataFrame:
    """The distinct latitudes and longitudes of a grid as rows (axis, value), in one pass, combined map-side.

    They are stored in the shared work folder, as the search reads them several times and the grid may be an archive.
    """
    pairs = "stack(2, 'latitude', latitude, 'longitude', longitude) AS (axis, value)"
    path = work_path(grid.sparkSession, "axes")
    grid.selectExpr(pairs).where("value IS NOT NULL").distinct().write.parquet(path)
    return grid.sparkSession.read.schema("axis string, value double").parquet(path)


def _nearest(points: DataFrame, axes: DataFrame, wrap: bool) -> DataFrame:
    """(axis, point, cell): the nearest value of the axis, of equally near ones the larger.

    Values and points of an axis are dealt to ``AXIS_BUCKETS`` even ranges of it and sorted there. Where a range has no value on one side of a
    point, the nearest filled range gives its own: that is looked up in a table with a row for each range.
    """
    around = (F.col("axis") == "longitude") & F.lit(wrap)

    def place(x: Column) -> Column:
        return F.when(around, grid_longitude(x)).otherwise(x)

    # of values that are the same place on the circle the larger one counts
    values = axes.select("axis", place(F.col("value")).alias("_at"), F.col("value").alias("_name")).groupBy("axis", "_at").agg(F.max("_name").alias("_name"))
    values = values.select("axis", "_at", F.struct("_at", "_name").alias("_value"))
    span = values.groupBy("axis").agg(F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
    part = F.floor((F.col("_at") - F.col("_lo._at")) / (F.col("_hi._at") - F.col("_lo._at")) * AXIS_BUCKETS)
    bucket = F.when(F.col("_hi._at") > F.col("_lo._at"), F.greatest(F.lit(0), F.least(F.lit(AXIS_BUCKETS - 1), part))).otherwise(0).cast("long")
    none = F.lit(None)
    both = values.select("axis", "_at", "_value", none.cast("double").alias("point")).union(
        points.select("axis", place(F.col("point")), none.cast(values.schema["_value"].dataType), "point"))
    both = both.join(span, "axis").withColumn("_bucket", bucket)
    edges = both.where("_value IS NOT NULL").groupBy("axis", "_bucket").agg(F.min("_value").alias("_first"), F.max("_value").alias("_last"))
    ranges = span.select("axis", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(AXIS_BUCKETS - 1).cast("long"))).alias("_bucket")).join(edges, ["axis", "_bucket"], "left")
    order = Window.partitionBy("axis").orderBy("_bucket")  # AXIS_BUCKETS rows
    ranges = ranges.select("axis", "_bucket", F.last("_last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"),
                           F.first("_first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
    here = Window.partitionBy("axis", "_bucket").orderBy("_at")
    found = both.select("axis", "_bucket", "point", "_lo", "_hi", F.max("_value").over(here.rangeBetween(Window.unboundedPreceding, 0)).alias("_lower"),
                        F.min("_value").over(here.rangeBetween(0, Window.unboundedFollowing)).alias("_upper")).where("point IS NOT NULL")
    # on the circle, before the first value comes the last one, and the other way round
    near = F.array(F.coalesce("_lower", "_below", F.when(around, F.col("_hi")))["_name"], F.coalesce("_upper", "_above", F.when(around, F.col("_lo")))["_name"])
    x = F.col("point")

    def distance(a: Column) -> Column:
        return F.when(around, F.least(F.pmod(a - grid_longitude(x), F.lit(360.0)), F.pmod(grid_longitude(x) - a, F.lit(360.0)))).otherwise(F.abs(a - x))

    best = F.array_min(F.transform(F.filter(near, lambda a: a.isNotNull()), lambda a: F.struct(distance(a).alias("d"), (-a).alias("a"))))
    return found.join(ranges, ["axis", "_bucket"]).select("axis", "point", (-best["a"]).alias("cell"))


def nearest_grid_cell(locations: DataFrame, axes: DataFrame, wrap: bool = True) -> DataFrame:
    """Add ``cell_latitude``, ``cell_longitude``: each axis searched on its own, ties to the larger value.

    ``axes`` comes from ``grid_axes``. ``wrap=True`` compares longitudes modulo 360, so -3.7 finds 356 on a 0..360 grid; ``wrap=False`` compares
    them as plain numbers. A location without coordinates, or a grid without rows, has null cells.
    """
    pairs = "stack(2, 'latitude', double(latitude), 'longitude', double(longitude)) AS (axis, point)"
    cells = _nearest(locations.selectExpr(pairs).where("point IS NOT NULL").distinct(), axes, wrap)
    out = locations
    for name in ("latitude", "longitude"):
        out = out.join(cells.where(F.col("axis") == name).select(F.col("point").alias(name), F.col("cell").alias(f"cell_{name}")), name, "left")
    return out.select(*locations.columns, "cell_latitude", "cell_longitude")


def extract_at_locations(locations: DataFrame, grid: DataFrame, wrap: bool = True,
                         axes: DataFrame | None = None) -> DataFrame:
    """Grid rows of each location's nearest cell, keyed by ``location_id``.

    Pass stored ``axes`` to save the pass over the coordinates of a large archive.
    """
    cells = nearest_grid_cell(locations, grid_axes(grid) if axes is None else axes, wrap)
    cells = cells.select("location_id", F.col("cell_latitude").alias("latitude"),
                         F.col("cell_longitude").alias("longitude"))
    return grid.join(cells, ["latitude", "longitude"])


def attach_elevation(locations: DataFrame, elevations: DataFrame) -> DataFrame:
    """Look up ``elevation`` by coordinates rounded to four decimals; null where unknown."""
    def rounded(df: DataFrame) -> DataFrame:
        return df.withColumns({"_lat": F.round("latitude", 4), "_lon": F.round("longitude", 4)})

    table = rounded(elevations).groupBy("_lat", "_lon").agg(F.max("elevation").alias("elevation"))
    return rounded(locations.drop("elevation")).join(table, ["_lat", "_lon"], "left").drop("_lat", "_lon")
