"""Windows, splits, validation and scores."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skybias.operators import features, metrics, validation, weighted
from skybias.plans import queries_scores
from skybias.plans.domain import domain
from skybias.sources import storage
from tests.conftest import hours

KEYS = ["location_id", "variable"]
RUN_SCHEMA = ("location_id STRING, variable STRING, split STRING, init_time TIMESTAMP, horizon INT, time TIMESTAMP, "
              "cams DOUBLE, observations DOUBLE, corrected DOUBLE, persistence DOUBLE")


@pytest.fixture(scope="module")
def runs(spark):
    """500 daily runs of 24 hours; every third is test."""
    rng = np.random.default_rng(42)
    frames = []
    for i, day in enumerate(pd.date_range("2019-06-01", periods=500, freq="D")):
        frames.append(pd.DataFrame({
            "location_id": "A", "variable": "pm25", "split": "test" if i % 3 == 0 else "train", "init_time": day,
            "horizon": range(24), "time": pd.date_range(day, periods=24, freq="h"), "cams": rng.integers(70, 100, 24).astype(float),
            "observations": rng.integers(45, 60, 24).astype(float), "corrected": rng.integers(50, 65, 24).astype(float),
            "persistence": rng.integers(45, 60, 24).astype(float)}))
    return spark.createDataFrame(pd.concat(frames), RUN_SCHEMA).cache()


def five(f, o):
    f, o = np.asarray(f), np.asarray(o)
    e = f - o
    return [np.abs(e).mean() / o.mean(), e.mean(), np.sqrt((e**2).mean()), np.abs(e - e.mean()).mean() / o.mean(), np.corrcoef(f, o)[0, 1]]


def test_run_scores_have_one_row_per_run_and_type(runs):
    scores = metrics.score_runs(runs)
    counts = {r["split"]: r["n"] for r in scores.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"train": 999, "test": 501}
    first = scores.where("init_time = '2019-06-01' AND type = 'CAMS'").first()
    local = runs.where("init_time = '2019-06-01'").orderBy("time").toPandas()
    assert [first[m] for m in ("nmae", "bias", "rmse", "debiased_nmae", "pearson")] == pytest.approx(five(local.cams, local.observations))


def test_mean_rows_average_runs(runs):
    scores = metrics.score_runs(runs)
    means = metrics.score_runs_mean(scores).where("run = 'Mean'")
    assert means.count() == 6
    want = scores.where("split = 'test' AND type = 'Persistence'").agg(F.avg("rmse")).first()[0]
    assert means.where("split = 'test' AND type = 'Persistence'").first()["rmse"] == pytest.approx(want)


def test_series_lengths_and_stacking(runs):
    n = {r["split"]: r["count"] for r in runs.groupBy("split").count().collect()}
    assert n == {"train": 7992, "test": 4008}
    stacked = validation.stack_series(runs)
    assert stacked.count() == 48000 and stacked.select("data_kind").distinct().count() == 8
    assert validation.scatter_pairs(runs).count() == 36000


@pytest.mark.parametrize("freq, label", [("h", "H"), ("3h", "3H"), ("D", "D"), ("3D", "3D"), ("7D", "7D"), ("15D", "15D"), ("MS", "MS"), ("QS", "QS")])
def test_resampling_equals_pandas(runs, freq, label):
    local = runs.where("split = 'test'").toPandas().set_index("time")
    want = local[["cams", "observations", "corrected", "persistence"]].resample(freq).mean().dropna()
    got = metrics.resample_validation(runs).where(f"split = 'test' AND resampling = '{label}'").toPandas().set_index("bin").sort_index()
    assert list(got.index) == list(want.index)
    assert np.allclose(got[want.columns], want)


def test_series_scores_cover_all_resolutions(runs):
    scores = metrics.score_series(runs)
    assert scores.count() == 2 * 11 * 3
    raw = scores.where("split = 'train' AND resampling = 'No Resampling' AND type = 'Corrected CAMS'").first()
    local = runs.where("split = 'train'").toPandas()
    assert [raw[m] for m in ("nmae", "bias", "rmse", "debiased_nmae", "pearson")] == pytest.approx(five(local.corrected, local.observations))


def test_perfect_and_shifted_forecasts(spark):
    df = spark.createDataFrame([(float(i), float(i) + 7, "k") for i in range(1, 11)], "o DOUBLE, f DOUBLE, k STRING")
    perfect = metrics.score(df.withColumn("p", F.col("o")), ["k"], "o", "p").first()
    assert list(perfect)[1:] == pytest.approx([0, 0, 0, 0, 1])
    shifted = metrics.score(df, ["k"], "o", "f", small_groups=True).first()
    assert shifted["bias"] == pytest.approx(7) and shifted["debiased_nmae"] == pytest.approx(0)
    flat = metrics.score(df.withColumn("z", F.lit(0.0)), ["k"], "z", "f").first()
    assert flat["nmae"] is None and flat["pearson"] is None


def test_regression_metrics_against_numpy(spark):
    rng = np.random.default_rng(3)
    y, p = rng.normal(size=(40, 3)), rng.normal(size=(40, 3))
    df = spark.createDataFrame([("m", h, float(y[i, h]), float(p[i, h])) for i in range(40) for h in range(3)],
                               "k STRING, horizon INT, label DOUBLE, prediction DOUBLE")
    out = metrics.regression_metrics(df, ["k"], digits=None).first()
    e = y - p
    assert out["explained_variance"] == pytest.approx((1 - e.var(0) / y.var(0)).mean())
    assert out["max_error"] == pytest.approx(np.abs(e).max())
    assert out["mean_absolute_error"] == pytest.approx(np.abs(e).mean())
    assert out["root_mean_squared_error"] == pytest.approx(np.sqrt((e**2).mean(0)).mean())
    assert out["r2"] == pytest.approx((1 - (e**2).sum(0) / ((y - y.mean(0)) ** 2).sum(0)).mean())
    base = metrics.baseline_metrics(df, ["k"]).first()
    assert base["mean_absolute_error"] == pytest.approx(np.abs(y).mean(), abs=1e-3)


@pytest.mark.parametrize("cams, train, test, accepted", [(10, 9, 9, False), (10, 7, 9, True), (10, 9, 7, True), (10, 8, 8, True)])
def test_acceptance(spark, cams, train, test, accepted):
    row = spark.range(1).select(metrics.acceptance_gate(F.lit(float(cams)), F.lit(float(train)), F.lit(float(test)))).first()
    assert row[0] is accepted


def hourly(table, values, skip=(), start="2024-01-28 00:00"):
    rows = [("A", "o3", t, v, v + 1) for t, v in hours(start, values, skip)]
    return table(rows, "location_id STRING, variable STRING, time TIMESTAMP, bias DOUBLE, observed DOUBLE")


@pytest.mark.parametrize("n_prev, n_future", [(3, 3), (24, 24), (5, 8), (700, 60)])
def test_windows_equal_brute_force(table, n_prev, n_future):
    values = [float(i) for i in range(2000)]
    skip = {100, 101, 1500}
    df = hourly(table, values, skip, start="2023-12-01")
    got = {str(r["init_time"]): list(r["bias"]) for r in features.sliding_samples(df, n_prev, n_future, ["bias"]).collect()}
    start, size, want = pd.Timestamp("2023-12-01"), n_prev + n_future, {}
    for a in range(0, 2000, 12):
        if a + size <= 2000 and not any(i in skip for i in range(a, a + size)):
            want[str(start + pd.Timedelta(hours=a + n_prev))] = values[a:a + size]
    assert got == want


def test_labels_do_not_leak(table):
    samples = features.sliding_samples(hourly(table, [float(i) for i in range(100)]), 6, 6, ["bias", "observed"])
    split = features.split_features_labels(samples, 6, 6, ["bias", "observed"])
    assert set(split.columns) == {"location_id", "variable", "init_time", "past_bias", "past_observed", "label"}
    row = split.orderBy("init_time").first()
    assert row["past_bias"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and row["label"] == [6.0, 7.0, 8.0, 9.0, 10.0, 11.0]


def test_split_is_chronological_and_disjoint(spark):
    df = spark.range(103).selectExpr("if(id < 100, 'A', 'B') AS location_id", "'o3' AS variable",
                                     "timestamp_seconds(1700000000 + id * 43200) AS init_time")
    out = features.train_test_split(df, 0.8)
    edges = {(r["location_id"], r["split"]): (r["n"], r["lo"], r["hi"]) for r in out.groupBy("location_id", "split").agg(
        F.count("*").alias("n"), F.min("init_time").alias("lo"), F.max("init_time").alias("hi")).collect()}
    assert edges["A", "train"][0] == 80 and edges["A", "test"][0] == 20 and edges["B", "train"][0] == 2
    assert edges["A", "train"][2] < edges["A", "test"][1]


@pytest.mark.parametrize("prev, future", [(6, 6), (24, 24), (12, 6), (5, 3)])
def test_window_times_are_those_of_the_windows(spark, prev, future):
    """Series with gaps, over the edges of chunks."""
    rng = np.random.default_rng(prev)
    rows = spark.range(2000).where(~F.col("id").isin([int(x) for x in rng.choice(2000, 12)])).selectExpr(
        "if(id % 3 = 0, 'A', 'B') AS location_id", "id").select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("location_id"), "id")
    rows = rows.where("NOT (location_id = 'B' AND id BETWEEN 700 AND 760)").selectExpr("location_id", "'o3' AS variable", "timestamp_seconds((id + 720 * 659 - 40) * 3600) AS time", "double(id) AS bias")
    key = lambda df: sorted((r["location_id"], r["init_time"]) for r in df.collect())
    times = key(features.window_times(rows, prev, future))
    assert times and times == key(features.sliding_samples(rows, prev, future, ["bias"]))


def test_dataset_packs_windows_once(spark, table):
    """The split is that of the windows' ranks; one aggregate collects rows, and what it makes is not shuffled again for the split."""
    rows = hourly(table, [float(i) for i in range(400)]).withColumn("bias", F.col("bias") + 0)
    places = spark.createDataFrame([("A", "UTC", 1.0, 2.0, 3.0)], "location_id STRING, timezone STRING, latitude DOUBLE, longitude DOUBLE, elevation DOUBLE")
    data = features.build_dataset(rows, places, 12, 6, fields=["bias"])
    plain = features.train_test_split(features.sliding_samples(rows, 12, 6, ["bias"]))
    key = lambda df: sorted((r["location_id"], r["init_time"], r["split"]) for r in df.collect())
    assert key(data) == key(plain) and {s for *_, s in key(data)} == {"train", "test"}
    assert data._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1


def test_shuffled_rows_are_the_rows_in_a_fixed_order(spark):
    df = spark.range(200).selectExpr("'A' AS location_id", "'o3' AS variable", "timestamp_seconds(id * 3600) AS init_time", "id")
    order = lambda seed, rows: [r["id"] for r in features.shuffle_rows(rows, seed).collect()]
    assert sorted(order(1, df)) == list(range(200)) and order(1, df) == order(1, df.repartition(7)) != order(2, df) and order(1, df) != list(range(200))


def test_min_station_rows(table):
    df = hourly(table, [1.0] * 10)
    assert features.min_station_rows(df, 10).count() == 10 and features.min_station_rows(df, 11).count() == 0


def test_scaling_uses_training_rows_and_keeps_constants(table, spark):
    rows = [("A", "o3", "train", 1.0, [1.0, 3.0], [5.0]), ("A", "o3", "train", 1.0, [1.0, 3.0], [2.0]), ("A", "o3", "test", 1.0, [100.0, 2.0], [2.0])]
    df = spark.createDataFrame(rows, "location_id STRING, variable STRING, split STRING, latitude_attr DOUBLE, past_t ARRAY<DOUBLE>, future_t ARRAY<DOUBLE>")
    out = features.scale_series(features.scale_attributes(df, ["latitude_attr"])).collect()
    assert all(r["latitude_attr"] == 0.0 for r in out)
    train = [r for r in out if r["split"] == "train"]
    assert train[0]["past_t"] == [-1.0, 1.0] and sorted(r["future_t"][0] for r in train) == [0.0, 3.0]


def test_validation_needs_every_hour(table, spark):
    processed = table([("A", "o3", t, v, 2 * v) for t, v in hours("2024-01-01", [float(i) for i in range(80)], skip={60})],
                      "location_id STRING, variable STRING, time TIMESTAMP, observed DOUBLE, forecast DOUBLE")
    inits = spark.createDataFrame([("2024-01-02",), ("2024-01-03",)], "t STRING")
    hat = inits.selectExpr("'A' AS location_id", "'o3' AS variable", "'test' AS split", "CAST(t AS TIMESTAMP) AS init_time",
                           "explode(sequence(0, 23)) AS horizon", "1.5D AS bias_hat")
    out = validation.build_validation(processed, hat).orderBy("time").collect()
    assert len(out) == 24 and str(out[0]["init_time"]) == "2024-01-02 00:00:00"
    assert (out[0]["cams"], out[0]["observations"], out[0]["corrected"], out[0]["persistence"]) == (48.0, 24.0, 46.5, 0.0)
    left = validation.incomplete_runs(processed, hat).collect()
    assert [(str(r["init_time"]), r["hours"]) for r in left] == [("2024-01-03 00:00:00", 23)]


def test_ensemble_mean_needs_every_member(spark):
    rows = [("A", "o3", "test", "2024-01-01", 0, 0, 1.0), ("A", "o3", "test", "2024-01-01", 1, 0, 3.0), ("A", "o3", "test", "2024-01-01", 0, 1, 5.0)]
    df = spark.createDataFrame(rows, "location_id STRING, variable STRING, split STRING, init_time STRING, member INT, horizon INT, bias_hat DOUBLE")
    assert {r["horizon"]: r["bias_hat"] for r in validation.ensemble_mean(df, 2).collect()} == {0: 2.0, 1: None}


def test_union_splits(spark):
    a, b = spark.createDataFrame([(1,)], "v INT"), spark.createDataFrame([(2,)], "v INT")
    assert validation.union_splits(a, b).count() == 2
    assert validation.union_splits(a, b, "test").first()["v"] == 2
    with pytest.raises(NotImplementedError):
        validation.union_splits(a, b, "both")


# --- weighted statistics ------------------------------------------------------------------------

ROWS = [("g", 1.0, 2.0, 1.0), ("g", 2.0, 1.0, 3.0), ("g", None, 5.0, 2.0), ("g", 4.0, 4.0, 0.0), ("c", 3.0, 1.0, 1.0), ("c", 3.0, 2.0, 1.0)]


@pytest.fixture
def small(spark):
    return spark.createDataFrame(ROWS, "k STRING, x DOUBLE, y DOUBLE, w DOUBLE")


def value(df, column, key="g"):
    return df.where(F.col("k") == key).first()[column]


def test_weighted_means(small):
    assert value(weighted.weighted_mean(small, ["k"], ["x"], "w"), "x") == pytest.approx(7 / 4)
    assert value(weighted.weighted_mean(small, ["k"], ["x"]), "x") == pytest.approx(7 / 3)
    assert weighted.weighted_mean(small, ["k"], ["x"], "w", dims=["depth"]).columns == small.columns
    with pytest.raises(Exception, match="weights do not add up"):
        weighted.weighted_mean(small.withColumn("w", F.lit(0.0)), ["k"], ["x"], "w").collect()


def test_weighted_rmsd_cov_corr(small):
    assert value(weighted.weighted_rmsd(small, ["k"], "x", "y", "w"), "rmsd") == pytest.approx(1.0)
    assert value(weighted.weighted_corr(small, ["k"], "x", "y", "w", return_p=False), "r") == pytest.approx(-1.0)
    assert value(weighted.weighted_corr(small, ["k"], "x", "y", "w", return_p=False), "n") == 3
    assert value(weighted.weighted_corr(small, ["k"], "x", "y", "w", return_p=False), "r", "c") is None
    both = small.where("x IS NOT NULL")
    assert value(weighted.weighted_cov(both, ["k"], "x", "y", "w"), "cov") == pytest.approx(-3 / 16)


@pytest.mark.parametrize("r, n, p", [(0.5, 10, 0.1411), (0.0, 12, 1.0), (0.9, 5, 0.03739), (-0.5, 10, 0.1411), (0.3, 100, 0.002426)])
def test_p_values(spark, r, n, p):
    got = spark.createDataFrame([(r, n)], "r DOUBLE, n LONG").select(weighted.correlation_p_value("r", "n")).first()[0]
    assert got == pytest.approx(p, rel=2e-3)


def test_p_value_of_two_pairs_is_null(spark):
    assert spark.createDataFrame([(0.3, 2)], "r DOUBLE, n LONG").select(weighted.correlation_p_value("r", "n")).first()[0] is None


def test_pair_sums_over_tasks_with_nulls(spark):
    from skybias.operators.comoments import pair_sums
    rng = np.random.default_rng(8)
    data = pd.DataFrame({"k": rng.choice(["a", "b"], 500), "g": rng.integers(0, 3, 500), **{c: rng.normal(size=500) for c in "xyz"}})
    for c in "xy":
        data.loc[rng.random(500) < 0.2, c] = None
    rows = spark.createDataFrame([tuple(None if isinstance(v, float) and v != v else v for v in r) for r in data.itertuples(index=False, name=None)], "k string, g long, x double, y double, z double")
    rows = rows.union(spark.createDataFrame([("c", None, 1.0, None, 2.0)], rows.schema)).repartition(6)
    pairs = [("x", "x"), ("x", "y"), ("z", "y"), ("z", "z")]
    found = {(r["k"], r["g"], r["_pair"]): [r[c] for c in ("_n", "_sa", "_sb", "_ab", "_aa", "_bb")] for r in pair_sums(rows, ["k", "g"], ["x", "y", "z"], pairs).collect()}
    for (k, g), part in data.groupby(["k", "g"]):
        for i, (a, b) in enumerate(pairs):
            both = part[part[a].notna() & part[b].notna()]
            x, y = both[a].to_numpy(), both[b].to_numpy()
            assert found[k, g, i] == pytest.approx([len(x), x.sum(), y.sum(), x @ y, x @ x, y @ y], rel=1e-9, abs=1e-9)
    assert found["c", None, 0][0] == 1 and ("c", None, 1) not in found and ("c", None, 3) in found
    assert pair_sums(rows.limit(0), ["k", "g"], ["x", "y", "z"], pairs).count() == 0


def test_density_reaches_far_rows_and_lists_flat_groups(spark):
    from skybias.operators import explore
    rng = np.random.default_rng(9)
    groups = {"wide": np.append(rng.normal(0, 1, 3000), [500.0]), "flat": np.full(4, 7.0), "one": np.array([3.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("none", None)], "k string, v double")
    out = explore.error_density(rows, ["k"], "v").toPandas()
    x = groups["wide"]
    at, h = np.linspace(x.min(), x.max(), 200), x.std(ddof=1) * len(x) ** -0.2
    want = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi)) * 5
    got = out[out.k == "wide"].sort_values("point")
    assert got.point.tolist() == list(range(200)) and got.density.to_numpy() == pytest.approx(want, abs=1e-13)
    flat = out[out.k != "wide"]
    assert sorted(zip(flat.k, flat.x)) == [("flat", 7.0), ("one", 3.0)] and flat.point.isna().all() and flat.density.isna().all()


def test_scaling_shuffles_no_row_of_the_dataset(spark):
    row = "if(id % 2 = 0, 'o3', 'no2') AS variable", "'train' AS split", "cast(id AS double) AS latitude_attr", "array(id % 5 + 0D, 2D) AS past_bias"
    out = features.scale_series(features.scale_attributes(spark.range(2_000_000).selectExpr(*row), ["latitude_attr"]), ["bias"])
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 2_000_000


def test_scores_shuffle_no_row_to_meet_the_means(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0), ("A", 3.0, 5.0), ("B", 2.0, None), (None, 1.0, 1.0)], "location_id string, observed double, forecast double")
    out = metrics.score(df, ["location_id"], "observed", "forecast")
    assert [(r.location_id, r.bias, r.debiased_nmae) for r in out.collect()] == [("A", 1.5, 0.25)]
    many = spark.range(2_000_000).selectExpr("id % 7 AS location_id", "id % 3 + 0D AS observed", "id % 5 + 0D AS forecast")
    assert "SortMergeJoin" not in metrics.score(many, ["location_id"], "observed", "forecast")._jdf.queryExecution().executedPlan().toString()


def test_types_are_scored_side_by_side(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({c: rng.normal(20, 5, 400) for c in ("observations", "cams", "corrected", "persistence")})
    rows = spark.createDataFrame(frame.assign(k=["a", "b"] * 200, n=range(400)))
    rows = rows.withColumn("cams", F.expr("if(k = 'b', NULL, cams)")).withColumn("observations", F.expr("if(n % 9 = 0, NULL, observations)"))
    stacked = rows.selectExpr("k", "observations", "stack(2, 'one', cams, 'two', corrected) AS (type, forecast)")
    for small in (False, True):
        want = {(r["k"], r["type"]): r for r in metrics.score(stacked, ["k", "type"], "observations", "forecast", small).collect()}
        out = metrics.score_side_by_side(rows, ["k"], "observations", {"cams": "one", "corrected": "two"}, small)
        found = {(r["k"], r["type"]): r for r in out.collect()}
        assert set(found) == set(want) == {("a", "one"), ("a", "two"), ("b", "two")}
        for key, r in found.items():
            assert [r[m] for m in metrics.METRICS] == pytest.approx([want[key][m] for m in metrics.METRICS])


def test_runs_are_scored_before_there_is_a_row_for_each_type(spark):
    schema = "location_id STRING, variable STRING, split STRING, init_time TIMESTAMP, observations DOUBLE, cams DOUBLE, corrected DOUBLE, persistence DOUBLE"
    plan = metrics.score_runs(spark.createDataFrame([], schema))._jdf.queryExecution().analyzed().toString()
    assert plan.index("Generate stack(3") < plan.index("Window")


def test_places_with_enough_rows_are_found_without_a_shuffle_of_all_rows(spark):
    rows = spark.range(2_000_000).selectExpr("concat('L', id % 3) AS location_id", "'pm25' AS variable", "timestamp_seconds(id * 3600) AS time")
    out = features.min_station_rows(rows, 10)
    assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    assert out.count() == 2_000_000


def test_members_come_after_the_join_with_the_label(spark, tmp_path):
    spark.createDataFrame([(i, f"2024-01-0{1 + i % 9} 0{i % 7}:00:00", i % 60, "click", float(i)) for i in range(400)],
                          "event_id LONG, ts STRING, user_id LONG, event_type STRING, value DOUBLE").selectExpr("event_id", "timestamp(ts) AS ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    out = queries_scores._labelled(domain(spark, str(tmp_path)))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.index("Generate explode(sequence(0, 4") < plan.index("Join")


def test_csv_has_no_file_for_each_place(spark, tmp_path):
    rows = spark.range(400).selectExpr('''concat(' place, "', id % 100, '" ') AS location_id''', "'pm25' AS variable", "timestamp_seconds(id * 3600) AS time", "id * 0.5D AS observed", "1D AS forecast", "2D AS bias")
    for by, files in ((["variable"], range(1, 9)), (["variable", "location_id"], [100])):
        path = f"{tmp_path}/{len(by)}"
        storage.export_processed_csv(rows, path, by)
        names = list(Path(path).rglob("*.csv"))
        assert len(names) in files and names[0].read_text().startswith(("location_id,time", "time,"))
    back = spark.read.schema("location_id STRING, time TIMESTAMP, observed DOUBLE, forecast DOUBLE, bias DOUBLE, variable STRING").option("header", True).csv(f"{tmp_path}/1")
    assert back.select(*rows.columns).exceptAll(rows).count() == 0 and back.count() == 400


def test_a_dataset_is_stored_as_hours_not_as_windows(spark, table, tmp_path):
    """Windows overlap by 36 hours; what is stored holds an hour once (twice near the edge of a chunk), and gives the same samples."""
    rows = hourly(table, [float(i % 97) for i in range(1500)], {300, 301})
    places = spark.createDataFrame([("A", "UTC", 1.0, 2.0, 3.0)], "location_id STRING, timezone STRING, latitude DOUBLE, longitude DOUBLE, elevation DOUBLE")
    storage.write_dataset(features.packed_dataset(rows, fields=["bias"]), str(tmp_path / "packed"))
    packed = storage.read_dataset(spark, str(tmp_path / "packed"))
    assert packed.selectExpr("sum(size(bias))").first()[0] <= 1498 + 36 * packed.count()
    samples = features.unpacked_dataset(packed, places, fields=["bias"])
    want = features.train_test_split(features.split_features_labels(features.sliding_samples(rows, 24, 24, ["bias"]), 24, 24, ["bias"]))
    want = features.attach_attributes(want, places)
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(samples) == key(want) and len(key(samples)) > 100
    assert "Exchange" not in samples._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_wide_predictions_are_shuffled_once(spark):
    rows = spark.range(480).selectExpr("'A' AS location_id", "'o3' AS variable", "'test' AS split", "int(id div 24 % 5) AS member",
                                       "timestamp_seconds(id div 120 * 43200) AS init_time", "int(id % 24) AS horizon", "if(id % 24 = 7, NULL, double(id)) AS bias_hat")
    wide = storage.wide_predictions(rows)
    found = {(r["init_time"].timestamp(), r["member"]): [r[str(h)] for h in range(1, 25)] for r in wide.collect()}
    assert len(found) == 20 and all(v[7] is None and [x - v[0] for i, x in enumerate(v) if i != 7] == [i for i in range(24) if i != 7] for v in found.values())
    assert wide._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2 and wide.columns[-24:] == [str(h) for h in range(1, 25)]


def test_validation_in_ranges_is_not_shuffled_for_its_folders(spark, table, tmp_path):
    processed = table([("A", v, t, x, 2 * x) for v in ("o3", "no2") for t, x in hours("2024-01-01", [float(i) for i in range(120)], skip={60})],
                      "location_id STRING, variable STRING, time TIMESTAMP, observed DOUBLE, forecast DOUBLE")
    hat = spark.createDataFrame([("A", v, t) for v in ("o3", "no2") for t in ("2024-01-02", "2024-01-03", "2024-01-04")], "location_id STRING, variable STRING, t STRING").selectExpr(
        "location_id", "variable", "if(variable = 'o3', 'test', 'train') AS split", "CAST(t AS TIMESTAMP) AS init_time", "explode(sequence(0, 23)) AS horizon", "1.5D AS bias_hat")
    plain, ranges = validation.build_validation(processed, hat), validation.build_validation(processed, hat, ranges=storage.VALIDATION_RANGES)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(plain) == exchanges(ranges) and "rangepartitioning" in ranges._jdf.queryExecution().executedPlan().toString()
    storage.write_validation(ranges, str(tmp_path / "v"), dealt=True)
    assert rows(storage.read_validation(spark, str(tmp_path / "v"))) == rows(plain) and len(rows(plain)) > 24
