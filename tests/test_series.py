"""Time-series operators on hand-computed values, across chunk edges, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skybias.operators import chunks, series, transform
from skybias.operators.explore import box_outliers, box_stats
from skybias.operators.quantiles import exact_quantiles, quantile_boxes
from tests.conftest import hours

KEYS = ["location_id", "variable"]
SCHEMA = "location_id STRING, variable STRING, time TIMESTAMP, observed DOUBLE"


def rows_of(values, start="2024-01-29 00:00", place="A", skip=()):
    return [(place, "o3", t, v) for t, v in hours(start, values, skip)]


def by_time(df, column):
    return {str(r["time"]): r[column] for r in df.collect()}


def test_hourly_mean(table):
    df = table([("A", "2024-01-01 00:10", 1.0), ("A", "2024-01-01 00:50", 3.0), ("A", "2024-01-01 01:00", 5.0)],
               "sensor_id STRING, time TIMESTAMP, value DOUBLE")
    assert by_time(series.hourly_mean(df, ["sensor_id"]), "value") == {"2024-01-01 00:00:00": 2.0, "2024-01-01 01:00:00": 5.0}


def test_distance_weights_round_half_to_even(spark):
    d = spark.createDataFrame([(0.5,), (1.0,), (8.0,), (1.81559141,), (300.0,)], "d DOUBLE")
    assert [r[0] for r in d.select(series.distance_weight(F.col("d"))).collect()] == [1.0, 1.0, 0.12, 0.55, 0.0]


def test_distance_weighted_mean(table):
    schema = "location_id STRING, variable STRING, sensor_id LONG, distance_km DOUBLE, time TIMESTAMP, value DOUBLE"
    rows = [("A", "o3", 1, 0.5, "2024-01-01", 10.0), ("A", "o3", 2, 2.0, "2024-01-01", 40.0),
            ("A", "o3", 1, 0.5, "2024-01-01 01:00", None), ("A", "o3", 2, 2.0, "2024-01-01 01:00", 40.0),
            ("A", "o3", 3, 500.0, "2024-01-01 02:00", 7.0)]
    out = by_time(series.distance_weighted_mean(table(rows, schema)), "observed")
    assert out == {"2024-01-01 00:00:00": pytest.approx(20.0), "2024-01-01 01:00:00": 40.0, "2024-01-01 02:00:00": 7.0}
    again = by_time(series.distance_weighted_mean(table(rows[::-1], schema)), "observed")
    assert again == pytest.approx(out)


def test_exact_quantiles_of_large_and_small_groups(spark):
    rng = np.random.default_rng(1)
    frames = [pd.DataFrame({"k": k, "v": v}) for k, v in {
        "hot": np.concatenate([rng.normal(0, 1, 30_000), rng.exponential(1e6, 50)]), "ties": rng.integers(0, 4, 20_000).astype(float),
        "tiny": np.array([1.0, 2.0, 10.0]), "one": np.array([5.0])}.items()]
    data = pd.concat(frames)
    out = exact_quantiles(spark.createDataFrame(data), ["k"], "v", {"q1": 0.25, "m": 0.5, "q3": 0.75, "top": 0.999})
    for r in out.collect():
        want = data.loc[data.k == r["k"], "v"].quantile([0.25, 0.5, 0.75, 0.999]).tolist()
        assert [r["q1"], r["m"], r["q3"], r["top"]] == pytest.approx(want, rel=1e-12), r["k"]


def test_exact_quantiles_over_several_tasks_and_scales(spark):
    """50,000 different values of one group over eight tasks; values of all sizes and signs, infinities, and many equal ones in one bin."""
    rng = np.random.default_rng(2)
    groups = {"many": rng.permutation(np.arange(50_000) * 0.37 - 3000), "near": 101_325 + rng.normal(0, 1e-7, 9001),
              "sizes": np.concatenate([rng.choice([-1, 1], 4000) * 10.0 ** rng.uniform(-300, 300, 4000), [0.0, -0.0]]),
              "ends": np.array([-np.inf, 1.0, 2.0, 3.0, np.inf]), "two": np.array([-1.0, 1.0])}
    data = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in groups.items()])
    rows = spark.createDataFrame(data).repartition(8)
    rows = rows.union(spark.createDataFrame([("many", None), ("none", None)], "k string, v double"))
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.987, "e": 1.0}
    found = {r["k"]: [r[c] for c in probs] for r in exact_quantiles(rows, ["k"], "v", probs).collect()}
    assert set(found) == set(groups)
    for k, v in groups.items():
        if k == "ends":
            assert (found[k][0], found[k][2], found[k][4]) == (-np.inf, 2.0, np.inf)
        else:
            assert found[k] == pytest.approx(np.quantile(v, list(probs.values())).tolist(), rel=1e-12), k
    assert exact_quantiles(rows.limit(0), ["k"], "v", probs).count() == 0


def test_iqr_filter_is_strict(table):
    df = table(rows_of([1.0, 2.0, 3.0, 4.0, 1000.0]) + rows_of([5.0, 5.0], place="B"), SCHEMA)
    kept = series.iqr_outlier_filter(df)
    assert sorted(r["observed"] for r in kept.collect()) == [1.0, 2.0, 3.0, 4.0]  # the constant series goes too
    approx = series.iqr_outlier_filter(df, approximate=True)
    assert sorted(r["observed"] for r in approx.collect()) == [1.0, 2.0, 3.0, 4.0]


def test_interpolation_stops_at_max_gap(table):
    # knots 12 h and 13 h apart, over a chunk edge
    edge = pd.Timestamp(0) + pd.Timedelta(hours=720 * 660)
    t = [edge - pd.Timedelta(hours=5), edge + pd.Timedelta(hours=7), edge + pd.Timedelta(hours=20)]
    df = table([("A", "o3", str(x), v) for x, v in zip(t, [0.0, 12.0, 25.0])], SCHEMA)
    out = by_time(series.interpolate_gaps(df), "observed")
    assert len(out) == 14
    for i in range(13):
        assert out[str(t[0] + pd.Timedelta(hours=i))] == pytest.approx(float(i))


def test_upsampling_equals_dense_interpolation(table):
    rng = np.random.default_rng(0)
    stamps = pd.date_range("2023-12-20", periods=600, freq="3h")[np.sort(rng.choice(600, 300, replace=False))]
    values = rng.normal(size=300)
    rows = [(p, str(t), float(v)) for p in "AB" for t, v in zip(stamps, values)]
    df = table(rows, "location_id STRING, time TIMESTAMP, v DOUBLE")
    out = series.upsample_linear(df, ["v"]).where("location_id = 'B'").orderBy("time").toPandas().set_index("time")["v"]
    want = pd.Series(values, stamps).resample("h").asfreq().interpolate("time")
    assert len(out) == len(want) and np.allclose(out.to_numpy(), want.to_numpy())


def test_next_row_and_rank_over_empty_chunks(table):
    df = table([("A", "2024-01-01", 1.0), ("A", "2024-06-01", 2.0), ("A", "2024-06-02", 3.0), ("B", "2024-01-05", 9.0)],
               "location_id STRING, time TIMESTAMP, v DOUBLE")
    nxt = {(r["location_id"], r["v"]): r["next_v"] for r in chunks.with_next(df, ["location_id"], ["v"]).collect()}
    assert nxt == {("A", 1.0): 2.0, ("A", 2.0): 3.0, ("A", 3.0): None, ("B", 9.0): None}
    rank = {(r["location_id"], r["v"]): (r["_rank"], r["_total"]) for r in chunks.with_rank(df, ["location_id"], "time").collect()}
    assert rank == {("A", 1.0): (1, 3), ("A", 2.0): (2, 3), ("A", 3.0): (3, 3), ("B", 9.0): (1, 1)}


def test_differences_equal_gradient_and_are_clipped(table):
    values = np.cumsum(np.random.default_rng(2).normal(0.3, 1, 900))
    df = table([("A", t, v) for t, v in hours("2023-12-25", values)], "location_id STRING, time TIMESTAMP, tp DOUBLE")
    out = series.differentiate_accumulated(df, ["tp"]).orderBy("time").toPandas()["tp"]
    assert np.allclose(out, np.clip(np.gradient(values), 0, None)) and (out >= 0).all()


def test_reset_aware_differences(table):
    df = table([("A", t, v) for t, v in hours("2024-01-01 22:00", [8.0, 10.0, 0.0, 3.0])], "location_id STRING, time TIMESTAMP, tp DOUBLE")
    aware = series.differentiate_accumulated(df, ["tp"], reset_aware=True).orderBy("time")
    assert [r["tp"] for r in aware.collect()] == [2.0, 2.0, 3.0, 3.0]
    plain = series.differentiate_accumulated(df, ["tp"]).orderBy("time")
    assert [r["tp"] for r in plain.collect()] == [2.0, 0.0, 0.0, 3.0]


def test_negative_readings_and_incomplete_rows(table):
    df = table(rows_of([-1.0, 0.0, None, 2.0]), SCHEMA)
    kept = series.drop_incomplete(series.negative_to_null(df))
    assert sorted(r["observed"] for r in kept.collect()) == [0.0, 2.0]


def test_deseasonalised_months_have_mean_zero(table):
    df = table(rows_of(list(np.arange(200.0))), SCHEMA)
    out = series.deseasonalise(df, ["observed"]).groupBy(F.month("time")).agg(F.avg("observed").alias("m"))
    assert all(abs(r["m"]) < 1e-9 for r in out.collect())


def test_daily_and_monthly_labels(table):
    df = table(rows_of([1.0] * 24 + [3.0] * 24 + [None] * 24, start="2024-01-30"), SCHEMA)
    assert by_time(series.resample_mean(df, "daily", ["observed"]), "observed") == {
        "2024-01-30 00:00:00": 1.0, "2024-01-31 00:00:00": 3.0}
    assert by_time(series.resample_mean(df, "monthly", ["observed"]), "observed") == {"2024-01-31 00:00:00": 2.0}
    with pytest.raises(KeyError):
        series.resample_mean(df, "weekly", ["observed"])


def test_forecast_minus_bias_is_observed(table):
    df = transform.add_bias(table([(3.0, 1.0), (1.0, 4.0)], "forecast DOUBLE, observed DOUBLE"))
    assert df.where("abs(forecast - bias - observed) > 1e-12").count() == 0


def test_negative_readings_do_not_enter_the_means(spark, table):
    from skybias.plans.jobs import nearby_hourly

    places = spark.createDataFrame([("A", 40.0, -3.0)], "location_id string, latitude double, longitude double")
    sensors = spark.createDataFrame([(1, "no2", "reference grade", 40.0, -3.0)],
                                    "sensor_id long, variable string, sensor_type string, latitude double, longitude double")
    rows = table([(1, "no2", "2020-01-01 00:10:00", 10.0, "µg/m³"), (1, "no2", "2020-01-01 00:20:00", -999.0, "µg/m³")],
                 "sensor_id LONG, variable STRING, time TIMESTAMP, value DOUBLE, unit STRING")
    assert [r.value for r in nearby_hourly(places, sensors, rows).collect()] == [10.0]


def test_places_at_the_same_spot_share_one_series(spark, table, monkeypatch):
    from skybias.plans import jobs

    places = spark.createDataFrame([("B", 40.0, -3.0), ("A", 40.0, -3.0), ("C", 40.3, -3.0), ("D", 40.0, -3.0), ("D", 40.3, -3.0), ("E", None, -3.0),
                                    (None, 40.0, -3.0)], "location_id string, latitude double, longitude double")
    sensors = spark.createDataFrame([(1, "no2", "reference grade", 40.1, -3.0), (2, "no2", "reference grade", 40.25, -3.2), (3, "no2", "reference grade", 20.0, 9.0)],
                                    "sensor_id long, variable string, sensor_type string, latitude double, longitude double")
    readings = table([(s, "no2", t, s * 10 + v, "µg/m³") for s in (1, 2, 3) for t, v in hours("2020-01-01 00:00", range(12), skip=(4, 5, 9))],
                     "sensor_id LONG, variable STRING, time TIMESTAMP, value DOUBLE, unit STRING")

    def rows(df):
        return sorted((r.location_id, r.variable, r.time, round(r.observed, 9)) for r in df.collect())

    want, joined, plain = rows(transform.observed_series(jobs.nearby_hourly(places, sensors, readings))), [], jobs.nearby_hourly
    monkeypatch.setattr(jobs, "nearby_hourly", lambda spots, *rest: joined.extend(r.location_id for r in spots.collect()) or plain(spots, *rest))
    assert rows(jobs.nearby_observed(places, sensors, readings)) == want and {r[0] for r in want} == set("ABCD")
    assert sorted(joined) == ["A", "C", "D", "D", "E"]


def test_quantiles_of_several_columns_at_once(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"k": np.repeat(["a", "b"], 4000), "x": rng.normal(0, 5, 8000), "y": rng.integers(0, 9, 8000).astype(float)})
    rows = spark.createDataFrame(data).withColumn("y", F.expr("if(k = 'b', NULL, y)")).repartition(4)
    found = {(r["k"], r["_i"]): [r["lo"], r["m"]] for r in quantile_boxes(rows, ["k"], ["x", "y"], {"lo": 0.25, "m": 0.5}).collect()}
    assert set(found) == {("a", 0), ("a", 1), ("b", 0)}  # no values, no row
    for (k, i), have in found.items():
        assert have == pytest.approx(data.loc[data.k == k, "xy"[i]].quantile([0.25, 0.5]).tolist(), rel=1e-12)


def test_boxes_meet_the_four_series_side_by_side(table):
    rows = [("A", "pm25", "train", f"2024-01-0{1 + i % 9} 05:00:00", float(i), float(i % 7), 300.0 if i == 3 else 1.0 + i % 2, None) for i in range(60)]
    validation = table(rows, "location_id STRING, variable STRING, split STRING, time TIMESTAMP, cams DOUBLE, observations DOUBLE, corrected DOUBLE, persistence DOUBLE")
    out = box_outliers(validation)
    assert [(r["data_type"], r["hour"], r["value"]) for r in out.collect()] == [("Corrected CAMS", 5, 300.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate stack") < plan.index("Join")  # rows become four only after they have met their boxes
    boxes = {r["data_kind"]: r for r in box_stats(validation, "month", "kind").collect()}
    assert set(boxes) == {"CAMS - (train)", "Observations - (train)", "Corrected CAMS - (train)"}
    one = boxes["Corrected CAMS - (train)"]
    assert (one["q1"], one["median"], one["q3"], one["whisker_low"], one["whisker_high"], one["outliers"]) == (1.0, 1.5, 2.0, 1.0, 2.0, 1)
    assert boxes["CAMS - (train)"]["median"] == 29.5
