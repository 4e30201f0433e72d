"""Model fitting, ensembles, saved members and the jobs, on a small seeded series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skybias.operators import boosting, elastic_net, features, models, moments
from skybias.plans import jobs
from skybias.schemas import RAW_FIELDS

FIELDS = ["pm25_forecast", "bias"]


@pytest.fixture(scope="module")
def locations(spark):
    rows = [("A", "Madrid", "Spain", 40.4, -3.7, "Europe/Madrid", 668.0), ("B", "Cairo", "Egypt", 30.06, 31.25, "Africa/Cairo", 28.0)]
    return spark.createDataFrame(rows, "location_id STRING, city STRING, country STRING, latitude DOUBLE, longitude DOUBLE, timezone STRING, elevation DOUBLE")


@pytest.fixture(scope="module")
def processed(spark):
    """Bias that repeats every 12 hours: the past window tells the future one."""
    rng = np.random.default_rng(5)
    frames = []
    for place, level in (("A", 10.0), ("B", -5.0)):
        t = pd.date_range("2024-01-01", periods=600, freq="h")
        bias = level + 5 * np.sin(2 * np.pi * np.arange(600) / 12) + rng.normal(0, 0.1, 600)
        frames.append(pd.DataFrame({"location_id": place, "variable": "pm25", "time": t, "bias": bias,
                                    "observed": 20.0 + rng.normal(0, 1, 600), "pm25_forecast": 20.0 + bias}))
    return spark.createDataFrame(pd.concat(frames)).cache()


@pytest.fixture(scope="module")
def dataset(processed, locations):
    """Two variables, so that nothing mixes them up."""
    both = processed.unionByName(processed.withColumns({"variable": F.lit("o3"), "bias": F.col("bias") * 2 + 1}))
    return features.build_dataset(both, locations, 12, 6, fields=FIELDS).cache()


def arrays(dataset, variable, split="train"):
    """Scaled inputs, labels and keys of one variable, by the plain scaling operators."""
    rows = models.model_inputs(dataset).where((F.col("variable") == variable) & (F.col("split") == split)).orderBy("location_id", "init_time").collect()
    return np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows]), rows


def test_sums_of_all_tasks_are_those_of_the_rows(dataset):
    layout = moments.layout_of(dataset, 12, 6)
    rows = layout.select(dataset.where("split = 'train'").repartition(7), *models.KEYS, "label")
    sums, shift = moments.products(rows, layout, [models.member_weight(m) for m in range(2)])
    parts = sums.collect()
    for v in ("pm25", "o3"):
        plain = rows.where(F.col("variable") == v).select("*", *[models.member_weight(m).alias(f"w{m}") for m in range(2)]).collect()
        z = np.column_stack([np.ones(len(plain)), np.array([r["x"] for r in plain]) - shift[v], np.array([r["label"] for r in plain])])
        for m in range(2):
            got = moments.whole([(r["block"], r["part"]) for r in parts if (r["variable"], r["member"]) == (v, m)], z.shape[1])
            assert got == pytest.approx((z * np.array([r[f"w{m}"] for r in plain])[:, None]).T @ z, rel=1e-9, abs=1e-6)
        one = moments.whole([(r["block"], r["part"]) for r in parts if (r["variable"], r["member"]) == (v, -1)], 2, False)
        assert one == pytest.approx(np.stack([z.sum(0), (z * z).sum(0)]), rel=1e-9, abs=1e-6)


def test_scalers_are_those_of_the_scaling_operators(dataset):
    ensemble = models.fit_model("elastic_net", dataset, alpha=0.1)
    for members in (1, 2):
        ensemble = models.fit_ensemble("elastic_net", dataset, members, alpha=0.1)
        for v in ("pm25", "o3"):
            raw = ensemble.layout.select(dataset.where((F.col("variable") == v) & (F.col("split") == "train")), *models.KEYS).orderBy("location_id", "init_time").collect()
            mean, scale = ensemble.scalers[v]
            assert (np.array([r["x"] for r in raw]) - mean) / scale == pytest.approx(arrays(dataset, v)[0], abs=1e-9)


def test_rows_with_a_missing_input_do_not_train(dataset):
    holed = dataset.withColumn("past_bias", F.when(F.col("init_time") == F.lit("2024-01-05").cast("timestamp"), F.transform("past_bias", lambda x: F.lit(None).cast("double"))).otherwise(F.col("past_bias")))
    less = dataset.where(F.col("init_time") != F.lit("2024-01-05").cast("timestamp"))
    for kind, params in (("elastic_net", {"alpha": 0.1}), ("gradient_boosting", {"rounds": 1, "depth": 2})):
        one, two = (models.fit_model(kind, d, **params).fitted["pm25", 0] for d in (holed, less))
        assert all(np.isfinite(a).all() for a in one.values())
        if kind == "elastic_net":
            assert one["coef"] == pytest.approx(two["coef"], abs=1e-6)


@pytest.mark.parametrize("alpha, ratio", [(0.3, 0.6), (0.01, 0.9), (2.0, 0.1), (0.5, 1.0)])
def test_elastic_net_minimises_the_stated_objective(alpha, ratio):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 9))
    x[:, 5] = x[:, 4] + 0.01 * rng.normal(size=200)
    x = (x - x.mean(0)) / x.std(0)
    x[:, 8] = 0  # a constant input
    y = x @ rng.normal(size=(9, 3)) + rng.normal(0, 0.2, (200, 3))
    want, yc = np.zeros((9, 3)), y - y.mean(0)
    for _ in range(20_000):  # plain coordinate descent
        for j in range(9):
            rho = x[:, j] @ (yc - x @ want + np.outer(x[:, j], want[j])) / 200
            below = x[:, j] @ x[:, j] / 200 + alpha * (1 - ratio)
            want[j] = elastic_net.soft(rho, alpha * ratio) / below if below else 0
    b, left = elastic_net.elastic_net(x.T @ x / 200, x.T @ yc / 200, alpha, ratio)
    assert b == pytest.approx(want, abs=1e-6) and left.max() < 1e-9
    again, _ = elastic_net.elastic_net(x.T @ x / 200, x.T @ yc / 200, alpha, ratio, start=rng.normal(size=(9, 3)))
    assert again == pytest.approx(b, abs=1e-6)


def test_fit_is_optimal_on_the_rows(dataset):
    for members in (1, 3):
        ensemble = models.fit_ensemble("elastic_net", dataset, members, alpha=0.2, l1_ratio=0.5)
        found = models.optimality(ensemble, dataset).collect()
        assert len(found) == 2 * members * 6 and max(r["violation"] for r in found) < 1e-6
    x, y, rows = arrays(dataset, "pm25")
    weight = {(r["location_id"], r["init_time"]): r["w"] for r in dataset.select("*", models.member_weight(1).alias("w")).where("variable = 'pm25' AND split = 'train'").collect()}
    w = np.array([weight[r["location_id"], r["init_time"]] for r in rows])
    fitted = ensemble.fitted["pm25", 1]
    slope = x.T @ (w[:, None] * (y - x @ fitted["coef"] - fitted["intercept"])) / w.sum() - 0.1 * fitted["coef"]
    assert np.abs(slope - 0.1 * np.sign(fitted["coef"]))[fitted["coef"] != 0].max() < 1e-7 and np.abs(slope[fitted["coef"] == 0]).max() < 0.1 + 1e-7
    broken = models.Ensemble("elastic_net", ensemble.layout, 3, ensemble.params, ensemble.scalers, {k: {**v, "coef": v["coef"] * 1.01} for k, v in ensemble.fitted.items()})
    assert max(r["violation"] for r in models.optimality(broken, dataset).collect()) > 1e-3


@pytest.mark.parametrize("kind, params", [("elastic_net", {"alpha": 0.01}), ("gradient_boosting", {"rounds": 6, "depth": 3})])
def test_members_beat_the_raw_forecast(dataset, kind, params):
    ensemble = models.fit_ensemble(kind, dataset, 2, **params)
    rows = models.evaluate(models.predict_members(ensemble, dataset)).collect()
    assert len(rows) == 4 and all(r["accepted"] for r in rows)
    assert all(r["test_mean_absolute_error"] < 0.5 * r["cams_mean_absolute_error"] for r in rows)


def test_members_differ_and_are_reproducible(dataset):
    def biases():
        ensemble = models.fit_ensemble("elastic_net", dataset, 2, alpha=0.01)
        return {(r["location_id"], r["variable"], r["init_time"], r["member"], r["horizon"]): r["bias_hat"] for r in models.predict_members(ensemble, dataset).collect()}

    first, second = biases(), biases()
    assert first == pytest.approx(second, abs=1e-9)
    assert any(abs(v - first[*k[:3], 1, k[4]]) > 1e-6 for k, v in first.items() if k[3] == 0)


def test_every_member_sees_every_training_row(dataset):
    """No training row has weight 0; weights have mean 1 and differ between members."""
    rows = dataset.where("split = 'train'").select(*[models.member_weight(m).alias(str(m)) for m in range(2)]).toPandas()
    assert rows.min().min() > 0 and rows.mean().to_numpy() == pytest.approx(1, abs=0.2) and (rows["0"] != rows["1"]).all()


@pytest.mark.parametrize("kind, params", [("elastic_net", {"alpha": 0.01}), ("gradient_boosting", {"rounds": 2, "depth": 2})])
def test_saved_members_are_the_fitted_ones(spark, dataset, tmp_path, kind, params):
    ensemble = models.fit_ensemble(kind, dataset, 2, **params)
    for _ in range(2):  # saving again replaces
        models.save_members(ensemble, spark, str(tmp_path))
    again = models.load_members(spark, str(tmp_path))
    assert (again.kind, again.layout, again.members, again.params) == (kind, ensemble.layout, 2, ensemble.params)
    key = lambda df: sorted((r["location_id"], r["variable"], str(r["init_time"]), r["member"], r["horizon"], r["bias_hat"]) for r in df.collect())
    assert key(models.predict_members(ensemble, dataset)) == key(models.predict_members(again, dataset))


def test_predictions_are_the_plain_product(dataset):
    ensemble = models.fit_model("elastic_net", dataset, alpha=0.05)
    got = {(r["location_id"], r["init_time"], r["horizon"]): (r["bias_hat"], r["label"]) for r in models.predict_members(ensemble, dataset).where("variable = 'o3' AND split = 'test'").collect()}
    x, y, rows = arrays(dataset, "o3", "test")
    want = x @ ensemble.fitted["o3", 0]["coef"] + ensemble.fitted["o3", 0]["intercept"]
    assert len(got) == len(rows) * 6
    for i, r in enumerate(rows):
        for h in range(6):
            assert got[r["location_id"], r["init_time"], h] == (pytest.approx(want[i, h], abs=1e-8), y[i, h])
    # a variable without a model has no predictions; no rows give none
    assert models.predict_members(ensemble, dataset.withColumn("variable", F.lit("so2"))).count() == 0
    assert models.predict_members(ensemble, dataset.limit(0)).count() == 0


def test_grid_search_equals_a_plain_search(dataset):
    grid = {"alpha": [0.05, 5.0], "l1_ratio": [0.2, 0.8]}
    got = {(r["variable"], r["alpha"], r["l1_ratio"]): (r["rank"], r["mae"]) for r in models.grid_search("elastic_net", dataset, grid, folds=3).collect()}
    assert len(got) == 8
    train = dataset.where("split = 'train'")
    layout = moments.layout_of(dataset, 12, 6)
    for v in ("pm25", "o3"):
        rows = layout.select(train.where(F.col("variable") == v).withColumn("fold", models.week_fold(3)), "location_id", "init_time", "fold", "label", *[c for c in dataset.columns if c.startswith("past_")]).collect()
        x, y, fold = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["fold"] for r in rows])
        weeks = {}
        for r in rows:  # a week of a place is on one side
            assert weeks.setdefault((r["location_id"], int(pd.Timestamp(r["init_time"], tz="UTC").timestamp()) // 604800), r["fold"]) == r["fold"]
        errors = {}
        for f in sorted(set(fold)):
            a, b = fold != f, fold == f
            mean, scale = np.zeros(layout.size), np.ones(layout.size)
            for name, at in layout.places().items():
                source = layout.places().get(name.replace("future_", "past_"), at)
                if name not in features.TIME_AUX:
                    mean[at], scale[at] = x[a][:, source].mean(), x[a][:, source].std() or 1.0
            z = (x - mean) / scale
            mx, my = z[a].mean(0), y[a].mean(0)
            for alpha in grid["alpha"]:
                for ratio in grid["l1_ratio"]:
                    w, _ = elastic_net.elastic_net((z[a] - mx).T @ (z[a] - mx) / a.sum(), (z[a] - mx).T @ (y[a] - my) / a.sum(), alpha, ratio)
                    errors.setdefault((alpha, ratio), []).append(np.abs(y[b] - my - (z[b] - mx) @ w).mean())
        for (alpha, ratio), e in errors.items():
            assert got[v, alpha, ratio][1] == pytest.approx(np.mean(e), rel=1e-6)
        order = sorted((got[k] for k in got if k[0] == v))
        assert [m for _, m in order] == sorted(m for _, m in order) and [r for r, _ in order] == [1, 2, 3, 4]


def test_grid_search_of_trees(dataset):
    best = models.grid_search("gradient_boosting", dataset, {"rounds": [1, 4], "depth": [2]}, folds=2).where("variable = 'pm25'").orderBy("rank").collect()
    assert [r["rounds"] for r in best] == [4.0, 1.0] and best[0]["mae"] < best[1]["mae"]


def plain_booster(x, y, w, edges, layout, rounds, depth, rate, ridge, bins, sketch):
    """Level-wise boosting by loops over nodes, inputs and bins."""
    b = np.zeros(x.shape, int)
    for name, at in layout.places().items():
        b[:, at] = np.searchsorted(edges.get(name.replace("future_", "past_"), []), x[:, at], "left")
    out = np.repeat(((w[:, None] * y).sum(0) / w.sum())[None], len(y), 0)
    for t in range(rounds):
        residual, node = y - out, np.zeros(len(y), int)
        view = np.random.default_rng([0, t]).standard_normal((y.shape[1], sketch)) / np.sqrt(sketch) if sketch else np.eye(y.shape[1])
        signal = residual @ view
        for _ in range(depth):
            go = np.zeros(len(y), int)
            for k in set(node):
                at, best = node == k, (1e-9, None)
                score = lambda m: (((w[m, None] * signal[m]).sum(0) ** 2).sum() / (w[m].sum() + ridge))
                for j in range(x.shape[1]):
                    for cut in range(bins - 1):
                        low = at & (b[:, j] <= cut)
                        high = at & ~low
                        if low.any() and high.any():
                            gain = score(low) + score(high) - score(at)
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (j, cut))
                if best[1]:
                    go[at] = b[at, best[1][0]] > best[1][1]
            node = 2 * node + go
        for k in set(node):
            at = node == k
            out[at] += rate * (w[at, None] * residual[at]).sum(0) / (w[at].sum() + ridge)
    return out


@pytest.mark.parametrize("sketch", [None, 2])
def test_boosting_equals_a_plain_booster(spark, dataset, sketch):
    small = dataset.where("variable = 'pm25'").select(*[c for c in dataset.columns if not c.startswith(("past_pm25", "future_"))]).repartition(5)
    params = {"rounds": 2, "depth": 2, "rate": 0.4, "bins": 5, "sketch": sketch}
    ensemble = models.fit_ensemble("gradient_boosting", small, 2, **params)
    train = ensemble.layout.select(small.where("split = 'train'").select("*", models.member_weight(1).alias("w")), *models.KEYS, "label", "w").collect()
    x, y, w = (np.array([r[c] for r in train]) for c in ("x", "label", "w"))
    want = plain_booster(x, y, w, ensemble.edges["pm25"], ensemble.layout, 2, 2, 0.4, 1.0, 5, sketch)
    assert ensemble.biases("pm25", x)[1] == pytest.approx(want, abs=1e-9)
    for c, edges in ensemble.edges["pm25"].items():
        assert edges == sorted(edges) and len(edges) <= 4, c


def test_foreign_model_scores_batches(dataset):
    rows = models.model_inputs(dataset).select(*models.KEYS, "features")
    out = models.foreign_predictions(rows, lambda x: np.repeat(x[:, :1], 6, axis=1), 6)
    assert out.count() == dataset.count() and all(len(r["bias_hat"]) == 6 for r in out.take(3))


def test_train_then_validate_then_report(processed, locations, tmp_path):
    path = str(tmp_path / "elastic")
    wide = processed.withColumn("forecast", F.col("pm25_forecast")).withColumns(
        {f"{f}_forecast": F.lit(1.0) for f in features.FIELDS if f != "pm25"})
    wide = wide.select("location_id", "variable", "time", *features.WINDOW_FIELDS, "forecast")
    both = wide.unionByName(wide.withColumn("variable", F.lit("o3")))
    for _ in range(2):  # a repeated run replaces its rows
        predictions = jobs.job_train(both, locations, "elastic_net", path, 12, 6, members=2, alpha=0.01)
    spark = processed.sparkSession
    assert sorted((r["variable"], r["member"], r["model"]) for r in spark.read.parquet(f"{path}/runs").collect()) == [(v, m, "elastic") for v in ("o3", "pm25") for m in (0, 1)]
    predictions = predictions.where("variable = 'pm25'")
    out = jobs.job_validate(wide, predictions, members=2, n_future=6)
    means = {(r["split"], r["type"]): r["rmse"] for r in out["set_of_runs"].where("run = 'Mean' AND location_id = 'A'").collect()}
    assert means["test", "Corrected CAMS"] < 0.3 * means["test", "CAMS"]
    for name in ("complete_series", "cycle_hour", "box_month_kind", "histogram_day", "density_hour"):
        assert out[name].count() > 0, name
    improvement = jobs.job_reports(spark.createDataFrame([("A", "pm25", 1, 1.0, 2.0)], "location_id STRING, variable STRING, sensor_id INT, distance_km DOUBLE, value DOUBLE")
                                   .withColumn("time", F.lit("2024-01-01").cast("timestamp")), out["validation"], "2024-01-01", "2024-01-31")
    assert improvement["improvement"].where("metric = 'RMSE' AND change_pct < -50").count() == 4
    assert improvement["availability"].first()["sensors"] == 1


def test_daily_correction_uses_no_later_observation(spark, locations, tmp_path):
    times = pd.date_range("2024-01-01", periods=8 * 20, freq="3h")
    frame = pd.DataFrame({"time": np.tile(times, 2), "location_id": np.repeat(["A", "B"], len(times))})
    for i, f in enumerate(RAW_FIELDS):
        frame[f] = {"msl": 101325.0, "t2m": 288.0, "pm2p5": 2e-8}.get(f, 1.0 + i)
    frame["pm2p5"] = 2e-8 * (1 + 0.2 * np.sin(np.arange(len(frame))))
    forecast = spark.createDataFrame(frame)
    hourly = pd.date_range("2024-01-01", periods=24 * 20, freq="h")
    seen = pd.DataFrame({"location_id": np.repeat(["A", "B"], len(hourly)), "variable": "pm25", "sensor_id": 1, "distance_km": 0.5,
                         "time": np.tile(hourly, 2), "value": 15 + np.random.default_rng(1).normal(0, 1, 2 * len(hourly))})
    observations = spark.createDataFrame(seen)
    processed = jobs.job_transform(forecast, observations, locations).cache()
    dataset = features.build_dataset(processed, locations, 12, 6, fields=FIELDS).cache()
    models.save_members(models.fit_model("elastic_net", dataset, alpha=0.01), spark, str(tmp_path / "model"))
    fitted = models.load_members(spark, str(tmp_path / "model"))
    day = "2024-01-15"
    # readings after the day began must not matter, and the last three hours before it may be missing
    late = observations.where(F.col("time") < F.expr(f"timestamp'{day}' - INTERVAL 3 HOURS"))
    correct = lambda seen, path=None: jobs.job_daily_correction(forecast, seen, locations, fitted, day, 12, 6, path)
    rows = lambda df: sorted((r["location_id"], r["horizon"], round(r["corrected"], 9)) for r in df.collect())
    whole = rows(correct(observations, str(tmp_path / "daily")))
    assert len(whole) == 12 and whole == rows(correct(observations.where(F.col("time") < day)))
    assert len(rows(correct(late))) == 12
    assert spark.read.parquet(str(tmp_path / "daily")).count() == 12
    assert np.mean([abs(corrected - 15) for _, _, corrected in whole]) < 3


def test_queries_fit_all_pollutants_hours_fields_and_members(spark, monkeypatch):
    """No query keeps a part of the hours, fields, pollutants or members; the fits themselves are left out here."""
    from skybias.plans import QUERIES
    from skybias.schemas import POLLUTANTS
    seen = []

    def fit(kind, dataset, members=5, **params):
        row = moments.layout_of(dataset, 24, 24).select(dataset, "label").first()
        assert len(row["label"]) == 24 and len(row["x"]) == len(features.STATION_ATTRS + features.TIME_AUX) + width
        seen.append((kind, members, sorted(r["variable"] for r in dataset.select("variable").distinct().collect())))

    monkeypatch.setattr(models, "fit_ensemble", fit)
    monkeypatch.setattr(models, "fit_model", lambda kind, dataset, **params: fit(kind, dataset, 1))
    monkeypatch.setattr(models, "predict_members", lambda ensemble, dataset: dataset.select("variable"))
    width = 24 * len(features.WINDOW_FIELDS) + 24 * sum(f not in ("observed", "bias") for f in features.WINDOW_FIELDS)
    for name, kind, members in (("fit_elastic_net", "elastic_net", 1), ("fit_gradient_boosting", "gradient_boosting", 1), ("fit_ensemble", "elastic_net", 5)):
        seen.clear()
        QUERIES[name](spark, "/root/testdata/sf0.01").limit(1).collect()
        assert seen == [(kind, members, sorted(POLLUTANTS))]


def test_histograms_of_inputs_one_after_the_other():
    rng = np.random.default_rng(4)
    bins, node, channels = rng.integers(0, 4, (500, 6)).astype(np.uint8), rng.integers(0, 3, 500), rng.normal(size=(500, 2))
    total = np.zeros((6, 12, 2))
    for rows in (slice(0, 200), slice(200, 500)):
        boosting.add_histograms(total, bins[rows], node[rows] * 4, channels[rows])
    want = np.zeros((6, 3, 4, 2))
    for b, n, c in zip(bins, node, channels):
        for i in range(6):
            want[i, n, b[i]] += c
    assert total.reshape(want.shape) == pytest.approx(want, abs=1e-12)


def test_python_gets_few_megabytes_at_a_time(spark):
    """Rows as wide as those of a dataset: a batch used to have 10,000 of them, whatever their size."""
    rows = spark.range(0, 6000, 1, 1).selectExpr("id", "transform(sequence(1, 823), x -> x * 0.5D) AS features")
    out = models.foreign_predictions(rows, lambda x: np.full((len(x), 1), float(len(x))), 1)
    assert out.selectExpr("max(bias_hat[0])").first()[0] < 2500


def test_tasks_take_more_partitions_when_rows_grow(spark):
    """150 MB shuffled by a session of eight partitions: no task takes more than 16 MB of it, plus what lies in one partition."""
    rows = spark.range(6_000_000).selectExpr("xxhash64(id) AS a", "xxhash64(id, 1) AS b", "xxhash64(id, 2) AS c")
    assert rows.repartition("a").rdd.getNumPartitions() > 8


def test_tasks_hand_on_each_matrix_once(spark):
    """Batches of all variables: with more than a dozen matrices in a task, each batch used to hand on its own."""
    layout = moments.Layout(("past_a",), (2,), 1)
    names = [f"v{i}" for i in range(5)]
    rows = spark.range(0, 4000, 1, 2).selectExpr(f"array({', '.join(map(repr, names))})[int(id % 5)] AS variable", "'A' AS location_id", "timestamp_seconds(id * 3600) AS init_time",
                                                 "transform(sequence(1, 9), i -> sin(id * i)) AS x", "array(cos(id)) AS label")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        weights = [models.member_weight(m) for m in range(5)]
        some = rows.select("variable", "x", F.col("label").alias("y"), F.lit(0).alias("fold"), F.array(*weights).alias("w"))
        shift = {v: np.zeros(9) for v in names}
        parts = some.mapInArrow(moments._products(shift, True), moments.PARTS).where("member >= 0")
        assert parts.count() == 2 * 5 * 5  # tasks, variables, members
        sums, shift = moments.products(rows, layout, weights)
        one = {r["variable"]: r["part"] for r in sums.where("member = -1").collect()}
        assert {v: np.frombuffer(bytes(p)).reshape(2, -1)[0, 0] for v, p in one.items()} == {v: 800.0 for v in names}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_predictions_are_dealt_as_windows(dataset):
    """With ``by``, a window is one row in the shuffle, not one for each member and horizon."""
    ensemble = models.fit_ensemble("elastic_net", dataset, 2, alpha=0.01)
    plain, dealt = models.predict_members(ensemble, dataset), models.predict_members(ensemble, dataset, ["variable", "split"])
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(plain) == key(dealt)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("RebalancePartitions")
