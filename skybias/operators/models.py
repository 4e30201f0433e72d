"""Bias models of all variables, forecast hours and members at once: fitting, stored members, batch scoring, evaluation.

An ``Ensemble`` is one small artefact: the scalers of each variable and the arrays of each (variable, member). It fits on the driver, is stored as
a table, and scores a batch of rows with matrix products. Its size depends on inputs, hours, members and variables, not on rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skybias.operators.boosting import binned, boosted, predicted
from skybias.operators.elastic_net import elastic_net
from skybias.operators.features import STATION_ATTRS, TIME_AUX, scale_attributes, scale_series
from skybias.operators.metrics import acceptance_gate, baseline_metrics, regression_metrics
from skybias.operators.moments import PARTS, Layout, added, blocks, layout_of, matrix, products, solved, whole
from skybias.schemas import SERIES
from skybias.session import work_path

KEYS = [*SERIES, "split", "init_time"]
SOLVED = "variable string, member int, fold int, choice int, coef array<double>, intercept array<double>"


@dataclass
class Ensemble:
    kind: str
    layout: Layout
    members: int
    params: dict
    scalers: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    fitted: dict[tuple[str, int], dict[str, np.ndarray]] = field(default_factory=dict)
    edges: dict[str, dict[str, list[float]]] = field(default_factory=dict)

    def biases(self, variable: str, x: np.ndarray) -> np.ndarray:
        """Biases (members, rows, hours) of unscaled inputs."""
        if self.kind == "elastic_net":
            mean, scale = self.scalers[variable]
            z = (x - mean) / scale
            return np.stack([z @ m["coef"] + m["intercept"] for m in (self.fitted[variable, i] for i in range(self.members))])
        bins = binned(x, self.layout, self.edges[variable])
        return np.stack([predicted(bins, self.fitted[variable, i]) for i in range(self.members)])


def model_inputs(dataset: DataFrame) -> DataFrame:
    """Scaled features as one array, label as another: what a model that was trained elsewhere takes."""
    scaled = scale_series(scale_attributes(dataset))
    windows = [c for c in dataset.columns if c.startswith(("past_", "future_"))]
    flat = ", ".join([f"array({', '.join(STATION_ATTRS + TIME_AUX)})", *windows])
    return scaled.select(*KEYS, F.expr(f"concat({flat})").alias("features"), "label")


def member_weight(member: int):
    """Weight of a row for one member: exponential with mean 1 (a Bayesian bootstrap), drawn from the row's key and the member number,
    so a recomputed task draws the same. It is never 0: no member is without a row."""
    draw = F.pmod(F.xxhash64("location_id", "variable", "init_time", F.lit(member)), F.lit(1 << 30))
    return -F.log((draw + 0.5) / float(1 << 30))


def week_fold(folds: int):
    """Fold of a row by place and week: windows overlap by 36 hours, so rows of one week must not be on both sides."""
    return F.pmod(F.xxhash64("location_id", F.expr("unix_timestamp(init_time) div 604800")), F.lit(folds))


def _row_shape(dataset: DataFrame) -> tuple[int, int]:
    """Past and future hours of the windows."""
    past = next(c for c in dataset.columns if c.startswith("past_"))
    row = dataset.select(F.size(past).alias("p"), F.size("label").alias("f")).first()
    return (row["p"], row["f"]) if row else (24, 24)


def _scaled(layout: Layout, total: np.ndarray, scaler: tuple[np.ndarray, np.ndarray], shift: np.ndarray):
    """Covariances of the scaled inputs, with the labels too, and both means, from the matrix of products."""
    mean, scale = scaler
    n, p = total[0, 0], layout.size
    at, labels = slice(1, 1 + p), slice(1 + p, None)
    mx, my = total[0, at] / n, total[0, labels] / n
    cov = (total[at, at] / n - np.outer(mx, mx)) / np.outer(scale, scale)
    return cov, (total[at, labels] / n - np.outer(mx, my)) / scale[:, None], (mx + shift - mean) / scale, my


def _plain_scaler(layout: Layout, n: float, sums: np.ndarray, squares: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaler of the unshifted inputs from sums around the shift. All steps of a field are brought to the shift of its first step."""
    common = shift.copy()
    for name, at in layout.places().items():
        common[at] = shift[at.start]
    apart = shift - common
    mean, scale = layout.scaler(n, sums + n * apart, squares + 2 * apart * sums + n * apart * apart)
    for name, at in layout.places().items():
        past = layout.places().get(name.replace("future_", "past_", 1), at)
        if name not in TIME_AUX and (not name.startswith("future_") or name.replace("future_", "past_", 1) in layout.places()):
            mean[at] += common[past.start]
    return mean, scale


def _matrices(group: pa.Table, size: int) -> dict[int, np.ndarray]:
    """Matrix of each fold."""
    rows: dict[int, list] = {}
    for f, b, p in zip(*(group.column(c).to_pylist() for c in ("fold", "block", "part")), strict=True):
        rows.setdefault(f, []).append((b, p))
    return {f: whole(r, size) for f, r in rows.items()}


def _fit_elastic_net(train: DataFrame, layout: Layout, members: int, alpha: float = 1.0, l1_ratio: float = 0.5) -> Ensemble:
    """One pass for the sums of all variables and members, then a task for each of them."""
    out = Ensemble("elastic_net", layout, members, {"alpha": alpha, "l1_ratio": l1_ratio})
    rows = layout.select(train, *KEYS, "label")
    path = work_path(train.sparkSession, "products")
    sums, shift = products(rows, layout, [member_weight(m) for m in range(members)] if members > 1 else None)
    sums.write.parquet(path)  # the solver and the scalers read it
    sums, size = train.sparkSession.read.parquet(path), 1 + layout.size + layout.horizons
    for v in shift:
        if members > 1:
            plain = whole([(r["block"], r["part"]) for r in sums.where((F.col("variable") == v) & (F.col("member") == -1)).collect()], 2, False)
            n, s, q = plain[0, 0], plain[0, 1:1 + layout.size], plain[1, 1:1 + layout.size]
        else:
            total = whole([(r["block"], r["part"]) for r in sums.where((F.col("variable") == v) & (F.col("member") == 0)).collect()], size)
            n, s, q = total[0, 0], total[0, 1:1 + layout.size], np.diag(total)[1:1 + layout.size]
        out.scalers[v] = _plain_scaler(layout, n, s, q, shift[v])
    scalers = out.scalers

    def solve(group: pa.Table) -> pa.Table:
        v, m = group.column("variable")[0].as_py(), group.column("member")[0].as_py()
        cov, cross, mx, my = _scaled(layout, _matrices(group, size)[0], scalers[v], shift[v])
        b, _ = elastic_net(cov, cross, alpha, l1_ratio)
        return pa.Table.from_pylist([{"variable": v, "member": m, "fold": 0, "choice": 0, "coef": b.ravel().tolist(), "intercept": (my - mx @ b).tolist()}], _schema())

    for r in solved(sums, solve, ["variable", "member"], SOLVED).collect():
        out.fitted[r["variable"], r["member"]] = {"coef": np.array(r["coef"]).reshape(layout.size, -1), "intercept": np.array(r["intercept"])}
    return out


def _schema() -> pa.Schema:
    long = pa.list_(pa.float64())
    return pa.schema([("variable", pa.string()), ("member", pa.int32()), ("fold", pa.int32()), ("choice", pa.int32()), ("coef", long), ("intercept", long)])


def _stored(df: DataFrame) -> DataFrame:
    path = work_path(df.sparkSession, "binned")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _fit_boosting(train: DataFrame, layout: Layout, members: int, **params) -> Ensemble:
    weights = [member_weight(m) for m in range(members)] if members > 1 else [F.lit(1.0)]
    models, edges = boosted(train, layout, weights, _stored, **params)
    return Ensemble("gradient_boosting", layout, members, params, fitted=models, edges=edges)


MODELS = {"elastic_net": _fit_elastic_net, "gradient_boosting": _fit_boosting}


def fit_ensemble(kind: str, dataset: DataFrame, members: int = 5, **params) -> Ensemble:
    """Members of every variable of ``dataset``, on all its training rows. Members differ by the weights of the rows; a single one weighs them alike."""
    return MODELS[kind](dataset.where("split = 'train'"), layout_of(dataset, *_row_shape(dataset)), members, **params)


def fit_model(kind: str, dataset: DataFrame, **params) -> Ensemble:
    return fit_ensemble(kind, dataset, 1, **params)


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, variable = matrix(batch.column("x")), np.array(batch.column("variable").to_pylist(), object)
            names = [c for c in batch.schema.names if c != "x"]
            out = np.full((batch.num_rows, shared.value.members * shared.value.layout.horizons), np.nan)
            for v in sorted(set(variable.tolist())):
                at = variable == v
                if (v, 0) in shared.value.fitted:
                    out[at] = shared.value.biases(v, x[at]).transpose(1, 0, 2).reshape(at.sum(), -1)
            cells = pa.ListArray.from_arrays(np.arange(0, out.size + 1, max(1, out.shape[1]), dtype=np.int32)[:len(out) + 1], pa.array(out.ravel()))
            yield pa.record_batch([*(batch.column(c) for c in names), cells], [*names, "biases"])

    return run


def predict_members(ensemble: Ensemble, dataset: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Long predictions ``bias_hat`` by member and horizon, with the label beside them: one pass, a matrix product for each batch.

    Rows of a variable that the ensemble doesn't know are left out. With ``by``, windows are rebalanced by these columns before they become a row for each
    member and horizon: what is stored by them needs no other shuffle.
    """
    known = sorted({v for v, _ in ensemble.fitted})
    label = F.col("label") if "label" in dataset.columns else F.lit(None).cast("array<double>").alias("label")
    rows = ensemble.layout.select(dataset.where(F.col("variable").isin(known)), *KEYS, label)
    shared, hours = dataset.sparkSession.sparkContext.broadcast(ensemble), ensemble.layout.horizons
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*KEYS, "label")), "biases array<double>"])
    scored = rows.mapInArrow(_scores(shared), schema)
    scored = scored.hint("rebalance", *by) if by else scored
    long = scored.selectExpr(*KEYS, "label", "posexplode(biases) AS (place, bias_hat)")
    return long.selectExpr(*KEYS, f"int(place div {hours}) AS member", f"int(place % {hours}) AS horizon", "bias_hat", f"label[int(place % {hours})] AS label")


def _gradients(shared, members: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            x, y, w = (matrix(batch.column(c)) for c in ("x", "y", "w"))
            variable = np.array(batch.column("variable").to_pylist(), object)
            complete = np.isfinite(x).all(1) & np.isfinite(y).all(1)
            for v in sorted(set(variable.tolist())):
                at = (variable == v) & complete
                mean, scale = shared.value.scalers[v]
                z, apart = (x[at] - mean) / scale, y[at] - shared.value.biases(v, x[at])
                for m in range(members):
                    wide = w[at, m, None] * apart[m]
                    held[v, m, 0] = held.get((v, m, 0), 0) + np.concatenate([z.T @ wide, wide.sum(0)[None], np.full((1, y.shape[1]), w[at, m].sum())])
        yield from blocks(held, TaskContext.get().partitionId(), symmetric=False)

    return run


def optimality(ensemble: Ensemble, dataset: DataFrame) -> DataFrame:
    """(variable, member, horizon, violation): by how much an elastic net misses its optimality conditions, relative to the largest gradient
    that they allow, from the residuals of all training rows; the sums that the fit came from are not used."""
    if ensemble.kind != "elastic_net":
        raise ValueError("optimality conditions are those of the elastic net")
    spark, members = dataset.sparkSession, ensemble.members
    train = dataset.where("split = 'train'")
    weights = [member_weight(m) for m in range(members)] if members > 1 else [F.lit(1.0)]
    rows = ensemble.layout.select(train, "variable", F.col("label").alias("y"), F.array(*weights).alias("w"))
    found = added(rows.mapInArrow(_gradients(spark.sparkContext.broadcast(ensemble), members), PARTS)).collect()
    l1 = ensemble.params["alpha"] * ensemble.params["l1_ratio"]
    l2, out = ensemble.params["alpha"] - l1, []
    for (v, m), fitted in sorted(ensemble.fitted.items()):
        total = whole([(r["block"], r["part"]) for r in found if (r["variable"], r["member"]) == (v, m)], ensemble.layout.size + 2, False)
        b, n = fitted["coef"], total[-1, 0]
        slope = total[:-2] / n - l2 * b
        breach = np.where(b != 0, np.abs(slope - l1 * np.sign(b)), np.maximum(np.abs(slope) - l1, 0)).max(0)
        breach = np.maximum(breach, np.abs(total[-2]) / n) / max(l1, 1e-12)
        out += [(v, m, h, float(e)) for h, e in enumerate(breach)]
    return spark.createDataFrame(out, "variable STRING, member INT, horizon INT, violation DOUBLE")


def foreign_predictions(samples: DataFrame, scorer, horizons: int, features: str = "features") -> DataFrame:
    """Batch scoring with a model trained elsewhere: ``scorer`` maps a 2-D array to one row of biases each."""
    import pandas as pd

    keys = [c for c in samples.columns if c != features]
    schema = samples.select(*keys).withColumn("bias_hat", F.lit(None).cast("array<double>")).schema

    def batches(frames):
        for frame in frames:
            out = frame[keys].copy()
            predicted_ = scorer(np.stack(frame[features].to_numpy())) if len(frame) else np.zeros((0, horizons))
            out["bias_hat"] = pd.Series(list(np.asarray(predicted_, dtype=float)), index=out.index, dtype=object)
            yield out

    return samples.mapInPandas(batches, schema)


def _errors(shared, choices: int):
    """Sums of absolute errors of each choice on the rows of the fold that it has not seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            x, y, fold = matrix(batch.column("x")), matrix(batch.column("y")), batch.column("fold").to_numpy()
            variable = np.array(batch.column("variable").to_pylist(), object)
            complete = np.isfinite(x).all(1) & np.isfinite(y).all(1)
            for v, f in sorted(set(zip(variable.tolist(), fold.tolist(), strict=True))):
                at = (variable == v) & (fold == f) & complete
                for c in range(choices):
                    apart = np.abs(y[at] - shared.value[v, f, c](x[at])).sum()
                    old = held.get((v, f, c), (0.0, 0))
                    held[v, f, c] = (old[0] + float(apart), old[1] + y[at].size)
        rows = [{"variable": v, "fold": f, "choice": c, "error": e, "n": n} for (v, f, c), (e, n) in held.items()]
        kinds = pa.schema([("variable", pa.string()), ("fold", pa.int32()), ("choice", pa.int32()), ("error", pa.float64()), ("n", pa.int64())])
        yield pa.RecordBatch.from_pylist(rows, kinds)

    return run


class Linear:
    """A linear model on unscaled inputs."""

    def __init__(self, coef: np.ndarray, intercept: np.ndarray):
        self.coef, self.intercept = coef, intercept

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef + self.intercept


class Trees:
    def __init__(self, layout: Layout, edges: dict, model: dict):
        self.layout, self.edges, self.model = layout, edges, model

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return predicted(binned(x, self.layout, self.edges), self.model)


def _path_models(train: DataFrame, layout: Layout, choices: list[dict], folds: int) -> dict:
    """Elastic nets of all choices, without each fold in turn: sums of a fold are taken off the total, and a path over falling alpha starts
    each fit where the one before ended. One pass over the rows, a task for each variable and fold."""
    sums, shift = products(layout.select(train, *KEYS, "label"), layout, None, week_fold(folds))
    size = 1 + layout.size + layout.horizons
    apart = sums.withColumn("without", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))

    def solve(group: pa.Table) -> pa.Table:
        v, out_fold = group.column("variable")[0].as_py(), group.column("without")[0].as_py()
        matrices = _matrices(group, size)
        total = sum(matrices.values())
        rest = total - matrices[out_fold] if out_fold in matrices else total
        rows, p = [], layout.size
        if rest[0, 0] < 0.5:  # a variable with rows in one fold only has none to fit on
            return pa.Table.from_pylist([], _schema())
        scaler = _plain_scaler(layout, rest[0, 0], rest[0, 1:1 + p], np.diag(rest)[1:1 + p], shift[v])
        cov, cross, mx, my = _scaled(layout, rest, scaler, shift[v])
        for ratio in sorted({c.get("l1_ratio", 0.5) for c in choices}):
            b = None
            for i in sorted((i for i, c in enumerate(choices) if c.get("l1_ratio", 0.5) == ratio), key=lambda i: -choices[i].get("alpha", 1.0)):
                b, _ = elastic_net(cov, cross, choices[i].get("alpha", 1.0), ratio, b)
                coef = b / scaler[1][:, None]
                rows.append({"variable": v, "member": 0, "fold": out_fold, "choice": i, "coef": coef.ravel().tolist(), "intercept": (my - mx @ b - scaler[0] @ coef).tolist()})
        return pa.Table.from_pylist(rows, _schema())

    found = solved(apart, solve, ["variable", "without"], SOLVED).collect()
    return {(r["variable"], r["fold"], r["choice"]): Linear(np.array(r["coef"]).reshape(layout.size, -1), np.array(r["intercept"])) for r in found}


def _tree_models(train: DataFrame, layout: Layout, choices: list[dict], folds: int) -> dict:
    """Boosted trees of each choice; the fits without each fold are members that give its rows no weight, so they share their passes."""
    out = {}
    for i, choice in enumerate(choices):
        models, edges = boosted(train, layout, [F.when(week_fold(folds) == f, 0.0).otherwise(1.0) for f in range(folds)], _stored, **choice)
        out |= {(v, f, i): Trees(layout, edges[v], model) for (v, f), model in models.items()}
    return out


def grid_search(kind: str, dataset: DataFrame, grid: dict[str, list], folds: int = 4) -> DataFrame:
    """(variable, rank, the parameters, mae): cross-validated mean absolute error of every choice, over all hours, the best first.

    Folds are by place and week. The models in flight are ``folds`` x choices x variables x inputs x hours numbers.
    """
    train, spark = dataset.where("split = 'train'"), dataset.sparkSession
    choices = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    layout = layout_of(dataset, *_row_shape(dataset))
    models = (_path_models if kind == "elastic_net" else _tree_models)(train, layout, choices, folds)
    known = spark.createDataFrame(sorted({(v, f) for v, f, _ in models}), "variable string, fold int")
    rows = layout.select(train.withColumn("fold", week_fold(folds).cast("int")), "variable", "fold", F.col("label").alias("y"))
    errors = rows.join(F.broadcast(known), ["variable", "fold"], "left_semi").mapInArrow(_errors(spark.sparkContext.broadcast(models), len(choices)), "variable string, fold int, choice int, error double, n long")
    per = errors.groupBy("variable", "fold", "choice").agg((F.sum("error") / F.sum("n")).alias("mae")).groupBy("variable", "choice").agg(F.avg("mae").alias("mae"))
    named = spark.createDataFrame([(i, *map(float, c.values())) for i, c in enumerate(choices)], ", ".join(["choice int", *(f"{k} double" for k in grid)]))
    rank = F.expr("row_number() OVER (PARTITION BY variable ORDER BY mae, choice)")  # the choices of a variable
    return per.join(F.broadcast(named), "choice").select("variable", rank.alias("rank"), *grid, "mae")


def evaluate(predictions: DataFrame, keys: list[str] = ["variable", "member"]) -> DataFrame:
    """Per member: scores on both splits, the raw forecast's scores on test, and whether it is accepted."""
    scores = regression_metrics(predictions, [*keys, "split"], prediction="bias_hat")
    names = [c for c in scores.columns if c not in [*keys, "split"]]
    both = scores.groupBy(*keys).agg(*[F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
                                       for s in ("train", "test") for c in names])
    raw = baseline_metrics(predictions.where("split = 'test'"), keys)
    raw = raw.withColumnsRenamed({c: f"cams_{c}" for c in raw.columns if c not in keys})
    gate = acceptance_gate(F.col("cams_mean_absolute_error"), F.col("train_mean_absolute_error"),
                           F.col("test_mean_absolute_error"))
    return both.join(raw, keys).withColumn("accepted", gate)


def write_model_runs(runs: DataFrame, path: str, name: str, kind: str, params: dict) -> None:
    """Evaluated members in the table of model runs, a folder for each model name: a repeated run replaces its rows. Rejected members stay, as
    ``accepted = false``."""
    text = ", ".join(f"{k}={v}" for k, v in sorted(params.items()))
    runs.withColumns({"kind": F.lit(kind), "params": F.lit(text)}).write.mode("overwrite").parquet(f"{path}/model={name}")


def save_members(ensemble: Ensemble, spark: SparkSession, path: str) -> None:
    """Scalers, arrays and a description, as two small tables."""
    arrays = [(v, -1, name, a) for v, pair in ensemble.scalers.items() for name, a in zip(("mean", "scale"), pair, strict=True)]
    arrays += [(v, -1, f"edges {c}", np.array(e, float)) for v, columns in ensemble.edges.items() for c, e in columns.items()]
    arrays += [(v, m, name, a) for (v, m), parts in ensemble.fitted.items() for name, a in parts.items()]
    rows = [(v, m, name, list(map(int, a.shape)), [float(x) for x in np.ravel(a)]) for v, m, name, a in arrays]
    spark.createDataFrame(rows, "variable string, member int, name string, shape array<int>, value array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/arrays")
    about = json.dumps({"kind": ensemble.kind, "members": ensemble.members, "params": ensemble.params, "layout": asdict(ensemble.layout)})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_members(spark: SparkSession, path: str) -> Ensemble:
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    layout = Layout(tuple(about["layout"]["windows"]), tuple(about["layout"]["lengths"]), about["layout"]["horizons"])
    out, pairs = Ensemble(about["kind"], layout, about["members"], about["params"]), {}
    for r in spark.read.parquet(f"{path}/arrays").collect():
        value = np.array(r["value"]).reshape(r["shape"])
        if r["member"] >= 0:
            whole_numbers = r["name"] in ("feature", "cut")
            out.fitted.setdefault((r["variable"], r["member"]), {})[r["name"]] = value.astype(int) if whole_numbers else value
        elif r["name"].startswith("edges "):
            out.edges.setdefault(r["variable"], {})[r["name"].removeprefix("edges ")] = value.tolist()
        else:
            pairs.setdefault(r["variable"], {})[r["name"]] = value
    out.scalers = {v: (p["mean"], p["scale"]) for v, p in pairs.items()}
    return out
