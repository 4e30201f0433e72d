"""Queries that fit and apply models of all pollutants, all 24 hours and all window fields.

What SQL can say about them is checked: that a fit is optimal, that a stored model is the fitted one, and which rows come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skybias.operators import features, models
from skybias.plans import jobs
from skybias.plans.registry import query
from skybias.session import work_path
from skybias.sources import storage

N_PREV, N_FUTURE, MEMBERS, ALPHA = 24, 24, 5, 0.5
# the reference grows 100 layers in trees of depth 6
ROUNDS, DEPTH = 17, 6
GRID = {"alpha": [0.1, 0.5, 1.0, 2.0, 5.0], "l1_ratio": [0.1, 0.5, 0.9]}


def dataset(d):
    """The dataset, as models are trained on it: all variables, locations, windows and fields. Its hours are stored, its windows are slices of them."""
    if "_dataset_path" not in d.__dict__:
        path = work_path(d.spark, "dataset")
        storage.write_dataset(features.packed_dataset(d.processed, N_PREV, N_FUTURE), path)
        d.__dict__["_dataset_path"] = path
    return features.unpacked_dataset(storage.read_dataset(d.spark, d.__dict__["_dataset_path"]), d.locations, N_PREV, N_FUTURE)


def _ensemble(d, members=MEMBERS):
    return models.fit_ensemble("elastic_net", dataset(d), members, alpha=ALPHA)


@query("fit_elastic_net")
def _(d):
    return models.predict_members(_ensemble(d, 1), dataset(d))


@query("elastic_net_optimality", tables="sample_splits", sql=f"""
       SELECT variable, m.member, h.horizon, TRUE AS optimal
       FROM (SELECT DISTINCT variable FROM sample_splits WHERE split = 'train') v,
            (SELECT unnest(generate_series(0, {MEMBERS - 1})) AS member) m, (SELECT unnest(generate_series(0, {N_FUTURE - 1})) AS horizon) h""")
def _(d):
    found = models.optimality(_ensemble(d), dataset(d))
    return found.select("variable", "member", "horizon", (F.col("violation") < 1e-6).alias("optimal"))


@query("fit_gradient_boosting")
def _(d):
    ensemble = models.fit_model("gradient_boosting", dataset(d), rounds=ROUNDS, depth=DEPTH)
    return models.predict_members(ensemble, dataset(d))


@query("fit_ensemble")
def _(d):
    return models.predict_members(_ensemble(d), dataset(d))


@query("grid_search")
def _(d):
    return models.grid_search("elastic_net", dataset(d), GRID)


@query("evaluate")
def _(d):
    return models.evaluate(models.predict_members(_ensemble(d), dataset(d)))


def _saved(d, members):
    path, ensemble = work_path(d.spark, "model"), _ensemble(d, members)
    models.save_members(ensemble, d.spark, path)
    return ensemble, models.load_members(d.spark, path)


@query("save_load_predict_members")
def _(d):
    return models.predict_members(_saved(d, 1)[1], dataset(d))


@query("saved_members_agree", tables="sample_splits", sql=f"""
       SELECT variable, split, m.member, count(*) * {N_FUTURE} AS predictions, 0 AS differing
       FROM sample_splits, (SELECT unnest(generate_series(0, {MEMBERS - 1})) AS member) m GROUP BY ALL""")
def _(d):
    fitted, loaded = _saved(d, MEMBERS)
    keys = [*models.KEYS, "member", "horizon"]
    one, two = (models.predict_members(e, dataset(d)).select(*keys, F.col("bias_hat").alias(c)) for e, c in ((fitted, "a"), (loaded, "b")))
    both = one.join(two, keys, "full")
    return both.groupBy("variable", "split", "member").agg(F.count("*").alias("predictions"), F.count_if(~F.equal_null("a", "b")).alias("differing"))


@query("foreign_predictions")
def _(d):
    rows = models.model_inputs(dataset(d)).select(*models.KEYS, "features")
    # stands for a network trained elsewhere: the mean of the inputs at every horizon
    return models.foreign_predictions(rows, lambda x: x.mean(axis=1, keepdims=True).repeat(N_FUTURE, axis=1), N_FUTURE)


@query("job_train")
def _(d):
    return jobs.job_train(d.processed, d.locations, "elastic_net", work_path(d.spark, "train"), N_PREV, N_FUTURE, MEMBERS, alpha=ALPHA)


@query("job_daily_correction")
def _(d):
    return jobs.job_daily_correction(d.forecast, d.observations, d.locations, _saved(d, MEMBERS)[1], "2024-01-20")
