"""Attribution of tree ensembles, exact and path-dependent, from a saved model's nodes.

A leaf's value is reached through the features of its path.  With z_i the share of training rows that
feature i's tests on the path let through and o_i 1 if the row passes them, else 0, the leaf adds
v * prod(z_i or o_i) to any coalition.  So feature j gets v (o_j - z_j) sum_k k! (m-k-1)! / m! e_k, where e_k are
coefficients of prod over i != j of (z_i + o_i t), and a pair gets the analogous term without both.  All
rows of a batch pass through a leaf at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch
from .models import Fitted

Leaf = tuple[float, list[tuple[int, float, float, float]]]


def leaves(spark: SparkSession, fitted: Fitted) -> list[Leaf]:
    """Per leaf of all trees: its weighted value, and per path feature (position, low, high, z): the row passes if
    low < x <= high.  As many as the model has leaves, whatever the data."""
    path = scratch(spark, "model")
    last = fitted.model.stages[-1]
    last.write().overwrite().save(path)
    data = spark.read.parquet(path + "/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    trees: dict[int, dict[int, object]] = {}
    for r in data.collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    weights = list(last.treeWeights) if hasattr(last, "treeWeights") else [1.0]
    out: list[Leaf] = []
    for tree, nodes in trees.items():
        w = weights[tree] if "GBT" in type(last).__name__ else 1.0 / len(trees)
        stack = [(0, {})]
        while stack:
            at, tests = stack.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                out.append((w * node["prediction"], [(f, *t) for f, t in tests.items()]))
                continue
            f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            whole = node["rawCount"]
            low, high, z = tests.get(f, (-np.inf, np.inf, 1.0))
            left, right = nodes[node["leftChild"]], nodes[node["rightChild"]]
            stack.append((left["id"], tests | {f: (low, min(high, cut), z * left["rawCount"] / whole)}))
            stack.append((right["id"], tests | {f: (max(low, cut), high, z * right["rawCount"] / whole)}))
    return out


def expected_value(model: list[Leaf]) -> float:
    return sum(v * float(np.prod([t[3] for t in tests])) for v, tests in model)


def _product(o: np.ndarray, z: np.ndarray, without: tuple[int, ...]) -> np.ndarray:
    """Coefficients of prod (z_i + o_i t), rows x degree."""
    e = np.ones((len(o), 1))
    for i in range(o.shape[1]):
        if i not in without:
            e = np.pad(e * z[i], ((0, 0), (0, 1))) + np.pad(e * o[:, i : i + 1], ((0, 0), (1, 0)))
    return e


def _passes(x: np.ndarray, tests: list) -> tuple[np.ndarray, np.ndarray]:
    o = np.stack([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in tests], 1).astype(float)
    return o, np.array([t[3] for t in tests])


def values(model: list[Leaf], x: np.ndarray) -> np.ndarray:
    """rows x features."""
    phi = np.zeros(x.shape)
    for v, tests in model:
        if v == 0 or not tests:
            continue
        o, z = _passes(x, tests)
        m = len(tests)
        weight = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
        for j, t in enumerate(tests):
            phi[:, t[0]] += v * (o[:, j] - z[j]) * (_product(o, z, (j,)) @ weight)
    return phi


def interactions(model: list[Leaf], x: np.ndarray) -> np.ndarray:
    """rows x features x features; a row sums over pairs to its attribution, the diagonal holding main effects."""
    out = np.zeros((*x.shape, x.shape[1]))
    for v, tests in model:
        m = len(tests)
        if v == 0 or m < 2:
            continue
        o, z = _passes(x, tests)
        weight = np.array([factorial(k) * factorial(m - k - 2) / (2 * factorial(m - 1)) for k in range(m - 1)])
        for i in range(m):
            for j in range(i):
                add = v * (o[:, i] - z[i]) * (o[:, j] - z[j]) * (_product(o, z, (i, j)) @ weight)
                out[:, tests[i][0], tests[j][0]] += add
                out[:, tests[j][0], tests[i][0]] += add
    phi = values(model, x)
    for f in range(x.shape[1]):
        out[:, f, f] = phi[:, f] - out[:, f].sum(1)
    return out


def _matrix(batch: pd.DataFrame, features: list[str]) -> np.ndarray:
    return batch[features].astype(float).fillna(0.0).to_numpy()


def attributions(fitted: Fitted, df: DataFrame, key: str) -> tuple[DataFrame, float]:
    """(key, phi): an array in the order of the model's features, and the expected value.  A gradient-boosted
    classifier's sums are margins: its probability is 1 / (1 + exp(-2 margin))."""
    model, features = leaves(df.sparkSession, fitted), fitted.features
    sent = df.sparkSession.sparkContext.broadcast(model)  # leaves of the model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "phi": list(values(sent.value, _matrix(b, features)))})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *features).mapInPandas(run, f"{key} {kind}, phi array<double>"), expected_value(model)


def interaction_strengths(fitted: Fitted, df: DataFrame) -> DataFrame:
    """(a, b, strength): the mean size of each pair's interaction; one row a pair of features."""
    model, features = leaves(df.sparkSession, fitted), fitted.features
    sent = df.sparkSession.sparkContext.broadcast(model)  # leaves of the model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total = np.abs(interactions(sent.value, _matrix(b, features))).sum(0)
            yield pd.DataFrame([(features[i], features[j], float(total[i, j]), len(b)) for i in range(len(features)) for j in range(i)], columns=["a", "b", "s", "n"])

    parts = df.select(*features).mapInPandas(run, "a string, b string, s double, n long")
    return parts.groupBy("a", "b").agg((F.sum("s") / F.sum("n")).alias("strength"))


def long_table(phi: DataFrame, key: str, features: list[str]) -> DataFrame:
    names = F.array(*(F.lit(f) for f in features))
    return phi.select(key, F.posexplode("phi").alias("pos", "phi")).withColumn("feature", F.element_at(names, F.col("pos") + 1))


def additivity(phi: DataFrame, predicted: DataFrame, key: str, expected: float, boosted: bool = True) -> DataFrame:
    """One row: the greatest difference between expected value plus attributions and the model's output p."""
    total = F.lit(expected) + F.aggregate("phi", F.lit(0.0), lambda s, x: s + x)
    out = 1 / (1 + F.exp(-2 * total)) if boosted else total
    return phi.join(predicted.select(key, "p"), key).agg(F.max(F.abs(out - F.col("p"))).alias("worst"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows of the smallest hashes: the same whatever the partitioning."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
