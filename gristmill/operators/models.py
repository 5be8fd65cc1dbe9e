"""Models over feature columns: fitting, random search, nested folds, ablation by feature family."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import combinations
from math import log

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch
from . import metrics, split, vif

# The search spaces.
FOREST_SPACE = {"numTrees": (150, 250, 350, 500), "maxDepth": (None, 8, 12, 16, 24, 32), "minInstancesPerNode": (1, 2, 4, 8), "featureSubsetStrategy": ("sqrt", "0.25", "0.4", "0.6")}
BOOST_SPACE = {"maxIter": (100, 200, 300, 400, 600), "maxDepth": (3, 4, 5, 6, 8), "stepSize": (0.01, 0.03, 0.05, 0.08, 0.12), "subsamplingRate": (0.6, 0.75, 0.85, 1.0), "featureSubsetStrategy": ("0.6", "0.75", "0.85", "all"), "minInstancesPerNode": (1, 2, 3, 5, 8)}
#: MLlib's deepest tree stands in for no limit.
DEEPEST = 30


@dataclass
class Fitted:
    """A model with the feature names it was fit on; scaled models carry their scaler."""

    model: PipelineModel
    features: list[str]
    kind: str
    scale: dict[str, float] | None = None

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Adds the probability of class 1, or the value limited to 0 and 1."""
        rows = _scaled(df, self.features, self.scale)
        done = self.model.transform(rows)
        p = vector_to_array("probability")[1] if self.kind == "classification" else F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
        keep = [F.col(f"`{c}`") for c in df.columns if c != out]
        return done.withColumn(out, p).select(*keep, out)

    def importances(self) -> dict[str, float]:
        last = self.model.stages[-1]
        values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
        return dict(zip(self.features, (float(x) for x in values.toArray())))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path + "/model")
        _session().createDataFrame([(json.dumps({"features": self.features, "kind": self.kind, "scale": self.scale}),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/features")

    @classmethod
    def load(cls, path: str) -> "Fitted":
        saved = json.loads(_session().read.text(path + "/features").first()[0])
        if not {"features", "kind"} <= saved.keys():
            raise ValueError(f"{path} holds no model with its features")
        return cls(PipelineModel.load(path + "/model"), saved["features"], saved["kind"], saved.get("scale"))


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def _scaled(df: DataFrame, features: Sequence[str], scale: Mapping[str, float] | None) -> DataFrame:
    x = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
    made = {f"__x_{i}": (x(c) - F.lit(scale[f"{c}__mean"])) / F.lit(scale[f"{c}__std"]) if scale else x(c) for i, c in enumerate(features)}
    return df.withColumns(made)


def _fit(df: DataFrame, features: Sequence[str], label: str, kind: str, estimator, standardise: bool = False) -> Fitted:
    scale = {k: (v if v is not None else 0.0) for k, v in vif.scaler(df, features).first().asDict().items()} if standardise else None
    rows = _scaled(df, features, scale).withColumn("__y", F.col(label).cast("double")).where("__y is not null")
    assembler = VectorAssembler(inputCols=[f"__x_{i}" for i in range(len(features))], outputCol="__features")
    estimator = estimator.setFeaturesCol("__features").setLabelCol("__y")
    return Fitted(Pipeline(stages=[assembler, estimator]).fit(rows), list(features), kind, scale)


def logistic(df, features, label, C: float = 1.0, l1: bool = False, max_iter: int = 2000) -> Fitted:  # noqa: N803
    """Penalised by 1 / (C n), L2 or L1, on standard scores; the intercept is free."""
    est = LogisticRegression(regParam=1.0 / (C * df.count()), elasticNetParam=float(l1), standardization=False, maxIter=max_iter)
    return _fit(df, features, label, "classification", est, True)


def ridge(df, features, label, alpha: float = 1.0) -> Fitted:
    """Least squares with alpha |w|^2 on standard scores: MLlib scales its penalty by the label's deviation."""
    n, sd = df.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
    est = LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False, regParam=alpha * (sd or 1.0) / max(n, 1))
    return _fit(df, features, label, "regression", est, True)


def _tree_params(params: Mapping) -> dict:
    return {k: (DEEPEST if k == "maxDepth" and (v is None or v > DEEPEST) else v) for k, v in params.items()}


def forest(df, features, label, kind: str = "classification", seed: int = 42, **params) -> Fitted:
    params = _tree_params({"numTrees": 300, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 3, "maxDepth": 12} | params)
    est = (RandomForestClassifier if kind == "classification" else RandomForestRegressor)(seed=seed, **params)
    return _fit(df, features, label, kind, est)


def boosted(df, features, label, kind: str = "classification", seed: int = 42, **params) -> Fitted:
    params = _tree_params({"maxIter": 300, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 3} | params)
    est = (GBTClassifier if kind == "classification" else GBTRegressor)(seed=seed, **params)
    return _fit(df, features, label, kind, est)


def _staged(df: DataFrame) -> DataFrame:
    """Written below the shared folder and read again: fits read a table many times, and its making, joins too, is done once."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scores_by(predicted: DataFrame, label: str, kind: str, keys: Sequence[str]) -> dict[tuple, float]:
    """ROC-AUC (0.5 with one class), or the negative mean squared error, of each group of predictions, in one pass."""
    if kind == "classification":
        return {tuple(r[k] for k in keys): 0.5 if r.roc_auc is None else r.roc_auc for r in metrics.roc_auc(predicted, label, keys=keys).collect()}
    return {tuple(r[k] for k in keys): -((r.rmse or 0.0) ** 2) for r in metrics.regression(predicted, label, keys=keys).collect()}


def predictions(df: DataFrame, jobs: Sequence[tuple[dict, Callable[[], tuple]]], label: str, parallel: int = 4) -> DataFrame:
    """Fits of several models at once, their predictions in one table: ``jobs`` are (keys, make), where ``make`` returns a model and the
    rows it is to score.  Each is written as soon as it is fit, below one path, its keys as partition columns."""
    path = scratch(df.sparkSession, "predictions")

    def one(job: tuple[dict, Callable[[], tuple]]) -> str:
        keys, make = job
        model, rows = make()
        place = "/".join([path, *(f"{k}={v}" for k, v in keys.items())])
        model.predict(rows).select(F.col(label).cast("double").alias(label), "p").write.parquet(place)
        return place

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        places = list(pool.map(one, jobs))
    return df.sparkSession.read.option("basePath", path).parquet(*places)


def sample(space: Mapping[str, Sequence | tuple], n: int, seed: int) -> list[dict]:
    """n draws of each parameter: from a sequence, or log-uniform between the ends of a set of two numbers."""
    rng = random.Random(seed)
    draw = lambda v: 2.718281828459045 ** rng.uniform(log(min(v)), log(max(v))) if isinstance(v, (set, frozenset)) else rng.choice(list(v))
    return [{k: draw(v) for k, v in space.items()} for _ in range(n)]


def search(
    df: DataFrame, features, label, kind: str, fit: Callable[..., Fitted], space: Mapping, n_iter: int = 28, inner: int = 4, seed: int = 42, key: str = "task_id", parallel: int = 4
) -> tuple[Fitted, dict, float]:
    """Random search by inner folds (stratified for classes), then a fit of the best on all rows.  Candidates are fitted
    ``parallel`` at a time and all their predictions scored by one grouped job; of equal means the first draw counts."""
    df = _staged(df)
    rows = _staged(split.folds(df, key, inner, seed, [label] if kind == "classification" else []))
    tried = sample(space, n_iter, seed)

    def job(c: int, k: int) -> tuple[dict, Callable[[], tuple]]:
        return {"candidate": c, "inner": k}, lambda: (fit(rows.where(F.col("fold") != k), features, label, **tried[c]), rows.where(F.col("fold") == k))

    found = scores_by(predictions(df, [job(c, k) for c in range(n_iter) for k in range(inner)], label, parallel), label, kind, ["candidate", "inner"])
    means = [sum(found.get((c, k), 0.5 if kind == "classification" else 0.0) for k in range(inner)) / inner for c in range(n_iter)]
    best = max(range(n_iter), key=lambda c: (means[c], -c))
    return fit(df, features, label, **tried[best]), tried[best], means[best]


def nested(df: DataFrame, features, label, kind: str, fit, space, outer: int = 10, n_iter: int = 28, inner: int = 4, seed: int = 42, key: str = "task_id", parallel: int = 4) -> list[dict]:
    """Per outer fold the best parameters of a search on the other folds, and the score on the fold; the outer folds' predictions are
    scored by one grouped job."""
    rows = _staged(split.folds(_staged(df), key, outer, seed).withColumnRenamed("fold", "__outer"))
    chosen: dict[int, dict] = {}

    def job(k: int) -> tuple[dict, Callable[[], tuple]]:
        def make() -> tuple:
            model, chosen[k], _ = search(rows.where(F.col("__outer") != k), features, label, kind, fit, space, max(6, n_iter // 2), max(2, min(4, inner)), seed + k, key, parallel)
            return model, rows.where(F.col("__outer") == k)

        return {"outer": k}, make

    found = scores_by(predictions(df, [job(k) for k in range(outer)], label, 1), label, kind, ["outer"])
    return [{"fold": k, "score": found.get((k,)), "params": chosen[k]} for k in range(outer)]


def cross_validated(df: DataFrame, features, label, kind: str, fit, k: int = 5, seed: int = 42, key: str = "task_id", group: str | None = None) -> DataFrame:
    """Out-of-fold predictions with fixed parameters; by groups none is on both sides."""
    df = _staged(df)
    rows = _staged(split.group_folds(df, group, k, seed) if group else split.folds(df, key, k, seed, [label] if kind == "classification" else []))
    out = None
    for i in range(k):
        part = fit(rows.where(F.col("fold") != i), features, label).predict(rows.where(F.col("fold") == i))
        out = part if out is None else out.unionByName(part)
    return out


def family_combos(families: Mapping[str, Sequence[str]]) -> list[tuple[str, list[str]]]:
    """All non-empty sets of families, named by "+", small sets first."""
    names = list(families)
    return [("+".join(c), [f for n in c for f in families[n]]) for k in range(1, len(names) + 1) for c in combinations(names, k)]


def ablation(train: DataFrame, test: DataFrame, families: Mapping[str, Sequence[str]], targets: Mapping[str, str], fit: Callable[..., Fitted], parallel: int = 4) -> list[dict]:
    """For each target (name to kind) and set of families: metrics on ``test``; a set without features is skipped.  The sets of a
    target are fitted ``parallel`` at a time and scored together."""
    out = []
    for target, kind in targets.items():
        combos = [(name, [c for c in columns if c in train.columns]) for name, columns in family_combos(families)]

        def job(i: int, columns: list[str], target: str = target, kind: str = kind) -> tuple[dict, Callable[[], tuple]]:
            return {"combo": i}, lambda: (fit(train, columns, target, kind=kind), test)

        jobs = [job(i, columns) for i, (_, columns) in enumerate(combos) if columns]
        found: dict[int, dict] = {}
        if jobs:
            p = predictions(train, jobs, target, parallel)
            parts = [metrics.ranking_scores(p, target, keys=["combo"]).withColumnRenamed("average_precision", "pr_auc"), metrics.brier(p, target, keys=["combo"])] if kind == "classification" else [metrics.regression(p, target, keys=["combo"])]
            for part in parts:
                for r in part.collect():
                    found.setdefault(r.combo, {}).update({k: v for k, v in r.asDict().items() if k != "combo"})
        out += [{"target": target, "components": name, "n_features": len(columns), "skipped": not columns, **found.get(i, {})} for i, (name, columns) in enumerate(combos)]
    return out


def screened(importances: Mapping[str, float]) -> list[str]:
    """Features of an importance other than 0."""
    return [f for f, v in importances.items() if v != 0]
