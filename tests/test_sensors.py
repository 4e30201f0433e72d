"""Radius join, grid cells and sensor choice."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skybias.operators import sensors, spatial
from skybias.schemas import CATALOGUE


def distance(a, b):
    (la, oa), (lb, ob) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2
    return 2 * 6373.0 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


@pytest.mark.parametrize("km", [50.0, 100.0, 900.0])
def test_radius_join_equals_brute_force(spark, km):
    # poles, the date line and dense neighbourhoods
    places = [("a", 89.9, 10.0), ("b", -89.5, -170.0), ("c", 0.1, 179.95), ("d", 52.0, -179.9), ("e", 40.4, -3.7), ("f", 75.0, 179.0)]
    spots = [(i, lat0 + dlat, lon0 + dlon) for i, (lat0, lon0, dlat, dlon) in enumerate(
        (lat, lon, dlat, dlon) for _, lat, lon in places
        for dlat in (-0.9, -0.3, 0.0, 0.05, 0.85) for dlon in (-150.0, -2.0, -0.4, 0.0, 0.7, 3.0, 90.0))]
    spots = [(i, max(-90.0, min(90.0, lat)), (lon + 180) % 360 - 180) for i, lat, lon in spots]
    locations = spark.createDataFrame(places, "location_id STRING, latitude DOUBLE, longitude DOUBLE")
    table = spark.createDataFrame(spots, "sensor_id LONG, latitude DOUBLE, longitude DOUBLE")
    rows = spatial.sensors_within_radius(locations, table, km).collect()
    got = sorted((r["location_id"], r["sensor_id"]) for r in rows)
    want = sorted((p[0], s[0]) for p in places for s in spots if distance(p[1:], s[1:]) <= km)
    assert got == want
    by_key = {(r["location_id"], r["sensor_id"]): r["distance_km"] for r in rows}
    for p in places:
        for s in spots:
            if (p[0], s[0]) in by_key:
                assert by_key[p[0], s[0]] == pytest.approx(distance(p[1:], s[1:]), abs=1e-6)


def test_radius_join_is_an_equi_join(spark):
    locations = spark.createDataFrame([("a", 1.0, 1.0)], "location_id STRING, latitude DOUBLE, longitude DOUBLE")
    table = spark.createDataFrame([(1, 1.0, 1.0)], "sensor_id LONG, latitude DOUBLE, longitude DOUBLE")
    plan = spatial.sensors_within_radius(locations, table)._jdf.queryExecution().optimizedPlan().toString()
    assert "_band" in plan and "Cartesian" not in plan


def test_nearest_cell_ties_and_wrap(spark):
    locations = spark.createDataFrame([("m", 0.5, -3.7), ("w", 10.4, 179.6)], "location_id STRING, latitude DOUBLE, longitude DOUBLE")
    grid = spark.createDataFrame([(float(a), float(o)) for a in range(-2, 12) for o in range(0, 360, 4)], "latitude DOUBLE, longitude DOUBLE")
    wrapped = {r["location_id"]: r for r in spatial.nearest_grid_cell(locations, spatial.grid_axes(grid)).collect()}
    assert (wrapped["m"]["cell_latitude"], wrapped["m"]["cell_longitude"]) == (1.0, 356.0)
    assert (wrapped["w"]["cell_latitude"], wrapped["w"]["cell_longitude"]) == (10.0, 180.0)
    plain = {r["location_id"]: r for r in spatial.nearest_grid_cell(locations, spatial.grid_axes(grid), wrap=False).collect()}
    assert plain["m"]["cell_longitude"] == 0.0


@pytest.mark.parametrize("wrap", [True, False])
def test_nearest_cell_equals_a_search_of_the_whole_axes(spark, wrap):
    """Uneven axes with gaps and close values, a value on both ends of the circle, places at, between and beyond axis values."""
    rng = np.random.default_rng(4)
    lats = np.unique(np.concatenate([rng.uniform(-60, 60, 300).round(2), 10 + np.arange(500) * 1e-4, [80.0]]))
    lons = np.unique(np.concatenate([rng.uniform(0, 90, 200).round(2), rng.uniform(300, 358, 40).round(1), [0.0, 360.0, 200.0]]))
    grid = spark.createDataFrame([(float(a), float(o)) for a, o in zip(np.resize(lats, 2000), np.resize(lons, 2000))], "latitude DOUBLE, longitude DOUBLE").repartition(4)
    places = [(str(i), float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 200), rng.uniform(-180, 180, 200)))]
    places += [("on", float(lats[3]), float(lons[3])), ("mid", float(lats[5] + lats[6]) / 2, -1e-9), ("far", -90.0, 180.0), ("end", 90.0, 359.9), ("none", None, None)]
    table = spark.createDataFrame(places, "location_id STRING, latitude DOUBLE, longitude DOUBLE")
    got = {r["location_id"]: (r["cell_latitude"], r["cell_longitude"]) for r in spatial.nearest_grid_cell(table, spatial.grid_axes(grid), wrap).collect()}
    assert len(got) == len(places) and got.pop("none") == (None, None)

    def nearest(axis, away):
        return -min((away(a), -a) for a in axis.tolist())[1]

    for name, lat, lon in places[:-1]:
        east = lon % 360.0
        away = (lambda o: min((o - east) % 360.0, (east - o) % 360.0)) if wrap else (lambda o: abs(o - lon))
        assert got[name] == (nearest(lats, lambda a: abs(a - lat)), nearest(lons, away)), name
    plan = spatial.nearest_grid_cell(table, spatial.grid_axes(grid), wrap)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "Cartesian" not in plan
    assert spatial.nearest_grid_cell(table, spatial.grid_axes(grid.limit(0)), wrap).where("cell_latitude IS NOT NULL OR cell_longitude IS NOT NULL").count() == 0


def test_catalogue_ranking(spark):
    """One sensor 0.73 km away that covers the whole period."""
    row = (1, "Madrid", "n", "e", "ES", [("1", "u", "n")], False, False,
           [(1, "µg/m³", 5, 1.0, 1.0, "no2", "NO2", None, 5, None)], "reference grade", None, None, 5, (40.4165 + 0.00657, -3.70256))
    catalogue = spark.createDataFrame([row], CATALOGUE)
    flat = (sensors.sensor_variables(sensors.has_parameter(catalogue, "no2"))
            .withColumn("first_updated", F.lit("2016-01-01").cast("timestamp"))
            .withColumn("last_updated", F.lit("2022-01-01").cast("timestamp")))
    locations = spark.createDataFrame([("ES001", 40.4165, -3.70256)], "location_id STRING, latitude DOUBLE, longitude DOUBLE")
    ranked = sensors.rank_sensors(sensors.candidate_sensors(locations, flat), "2019-06-01", "2021-03-31").first()
    assert ranked["coverage"] == 1.0 and ranked["rank_key"] == ranked["distance_km"]
    assert ranked["distance_km"] == pytest.approx(0.7308, abs=1e-3)
    assert sensors.has_parameter(catalogue, "o3").count() == 0


@pytest.mark.parametrize("first, last, want", [
    ("2020-01-01", "2022-01-01", 1.0), ("2021-03-05", "2022-01-01", -1.0), ("2020-01-01", "2020-06-01", 0.0),
    ("2021-02-02 13:00", "2022-01-01", (27 * 24 + 1) / (28 * 24 + 1)), ("2020-01-01", "2021-02-03 05:00", 49 / (28 * 24 + 1))])
def test_coverage(spark, first, last, want):
    c = sensors.temporal_coverage("2021-02-01", "2021-03-01", F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"))
    assert spark.range(1).select(c).first()[0] == pytest.approx(want)


def test_grade_units_and_top_k(spark, table):
    schema = "location_id STRING, variable STRING, sensor_id LONG, sensor_type STRING, rank_key DOUBLE"
    rows = [("A", "o3", 1, "low-cost sensor", 1.0), ("A", "o3", 2, "reference grade", 9.0), ("A", "o3", 3, "reference grade", 9.0),
            ("B", "o3", 4, "low-cost sensor", 2.0)]
    kept = sensors.prefer_reference_grade(spark.createDataFrame(rows, schema))
    assert sorted(r["sensor_id"] for r in kept.collect()) == [2, 3, 4]
    usable = spark.createDataFrame([(2, "o3"), (3, "o3"), (4, "o3")], "sensor_id LONG, variable STRING")
    top = sensors.top_k_sensors(kept, usable, 1)
    assert sorted((r["location_id"], r["sensor_id"]) for r in top.collect()) == [("A", 2), ("B", 4)]
    m = spark.createDataFrame([(1, "o3", "ppm"), (1, "o3", "µg/m³"), (2, "o3", "ppm"), (3, "o3", "furlong"), (4, "o3", None)],
                              "sensor_id LONG, variable STRING, unit STRING")
    assert [r["sensor_id"] for r in sensors.homogeneous_units(m).collect()] == [2]


def test_time_range_is_open_left_closed_right(table):
    df = table([("2024-01-01",), ("2024-01-01 00:00:01",), ("2024-01-02",), ("2024-01-02 00:00:01",)], "time TIMESTAMP")
    assert sensors.time_range_filter(df, "2024-01-01", "2024-01-02").count() == 2


def test_top_k_is_cut_before_the_shuffle(spark):
    variable = "if(id > 5, 'o3', 'no2') AS variable"
    ranked = spark.range(10).selectExpr("if(id > 5, 'A', 'B') AS location_id", variable, "id AS sensor_id", "rand() AS rank_key")
    usable = spark.range(10).selectExpr("id AS sensor_id", variable)
    plan = sensors.top_k_sensors(ranked, usable)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
