"""Boosting against a plain version, folds by a brute-force rule, searches scored in one pass."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.operators import boosting, metrics, models, split


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(400, 3)), 2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0.5)).astype(int)
    data = pd.DataFrame({"k": range(400), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "z": np.clip(0.3 * x[:, 0] + 0.5, 0, 1)})
    return spark.createDataFrame(data.astype({"k": "int64"})), data


def plain(x, y, cuts, kind, trees, depth, rate, l2, min_child):
    """The same greedy trees by loops over rows."""
    mean = y.mean()
    margin = np.full(len(y), np.log(mean / (1 - mean)) if kind == "classification" else mean)
    bins = [np.array([sum(c < v for c in cut) for v in col]) for col, cut in zip(x.T, cuts)]
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y, p * (1 - p)) if kind == "classification" else (margin - y, np.ones(len(y)))
        splits, value, step = {}, {}, np.zeros(len(y))

        def grow(node, rows, level):
            value[node] = -rate * g[rows].sum() / (h[rows].sum() + l2)
            best = (0.0, None)
            if level < depth:
                for f in range(len(bins)):
                    for b in range(len(cuts[f])):
                        left = rows[bins[f][rows] <= b]
                        right = rows[bins[f][rows] > b]
                        if b not in bins[f][rows] or not len(left) or not len(right) or h[left].sum() < min_child or h[right].sum() < min_child:
                            continue
                        term = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                        gain = round(0.5 * (term(left) + term(right) - term(rows)), 12)
                        if gain > best[0]:
                            best = (gain, (f, b, left, right))
            if best[1] is None:
                step[rows] = value[node]
                return
            f, b, left, right = best[1]
            splits[node] = (f, b)
            grow(2 * node + 1, left, level + 1)
            grow(2 * node + 2, right, level + 1)

        grow(0, np.arange(len(y)), 0)
        margin = margin + step
        made.append(splits)
    return made, margin


@pytest.mark.parametrize("kind,label", [("classification", "y"), ("regression", "z")])
def test_boosting_equals_a_plain_version_split_by_split(table, kind, label):
    df, data = table
    names = ["a", "b", "c"]
    made = boosting.boost(df, names, label, kind, trees=3, depth=3, rate=0.3, bins=8, l2=1.0, min_child=2.0, stage_every=2)
    x = data[names].to_numpy()
    cuts = [sorted(set(np.quantile(x[:, i], [j / 8 for j in range(1, 8)]))) for i in range(3)]
    for f, c in zip(names, cuts):
        assert np.allclose(made.cuts[f], c)
    want, margin = plain(x, data[label].to_numpy().astype(float), cuts, kind, 3, 3, 0.3, 1.0, 2.0)
    assert [t.splits for t in made.trees] == want
    p = made.predict(df).orderBy("k").toPandas().p
    assert np.allclose(p, 1 / (1 + np.exp(-margin)) if kind == "classification" else np.clip(margin, 0, 1), atol=1e-9)
    assert sum(made.importances().values()) == pytest.approx(1)


def test_boosting_learns_and_takes_odd_rows(spark, table):
    df, _ = table
    odd = df.unionByName(spark.createDataFrame([(1000, None, float("nan"), None, 1, 0.5), (1001, 1.0, 1.0, 1.0, None, None)], df.schema))
    model = boosting.boosted(odd, ["a", "b", "c"], "y", trees=6, rate=0.5, min_child=1.0)
    again = boosting.boosted(odd.repartition(3), ["a", "b", "c"], "y", trees=6, rate=0.5, min_child=1.0)
    assert [t.splits for t in model.trees] == [t.splits for t in again.trees]
    assert metrics.roc_auc(model.predict(df)).first()[0] > 0.9
    with pytest.raises(ValueError, match="label"):
        boosting.boost(df.limit(0), ["a"], "y", trees=1)
    constant = boosting.boost(df.withColumn("one", F.lit(1.0)), ["one"], "y", trees=2)
    assert all(not t.splits for t in constant.trees)


@pytest.mark.parametrize("largest", [1000, 6])
def test_stratified_group_folds(spark, largest):
    rng = np.random.default_rng(7)
    rows = [(f"g{g}" if g else None, int(rng.random() < (g % 5) / 5), i) for i, g in enumerate(np.minimum(rng.geometric(0.06, 3000) - 1, 60).tolist())]
    df = spark.createDataFrame(rows, "g string, y int, i long")
    out = split.stratified_group_folds(df, "g", "y", 4, largest=largest).toPandas()
    assert len(out) == len(rows) and sorted(out.fold.unique()) == [0, 1, 2, 3]
    assert (out.groupby("g", dropna=False).fold.nunique() == 1).all()
    share = out.groupby("fold").y.mean()
    assert (share - out.y.mean()).abs().max() < (0.06 if largest == 1000 else 0.15)  # 12 bundles are coarse
    size = out.groupby("fold").size()
    assert size.max() < 1.35 * size.min() or largest == 6
    if largest == 1000:  # the greedy rule itself, over groups as pandas counts them
        table = out.assign(g=out.g.fillna("")).groupby(["g", "y"]).size().unstack(fill_value=0)
        counts, folds = table.to_numpy(float), np.zeros((4, 2))
        mine = out.assign(g=out.g.fillna("")).groupby("g").fold.first()
        spread = lambda f: np.std(f / counts.sum(0), axis=0).mean()
        final = np.array([counts[[mine[g] == k for g in table.index]].sum(0) for k in range(4)])
        for i in np.argsort(-counts.std(1), kind="stable"):
            best = min(range(4), key=lambda k: round(spread(folds + np.outer(np.arange(4) == k, counts[i])), 12))
            folds[best] += counts[i]
        assert spread(final) <= spread(folds) + 0.01


def test_search_scores_all_candidates_together(table):
    df, _ = table
    fit = lambda d, f, y, depth: boosting.boost(d, f, y, trees=3, depth=depth, rate=0.5)
    model, params, best = models.search(df, ["a", "b"], "y", "classification", fit, {"depth": (1, 3)}, n_iter=3, inner=2, key="k")
    rows = split.folds(df, "k", 2, 42, ["y"]).persist()
    tried = models.sample({"depth": (1, 3)}, 3, 42)
    means = []
    for c in tried:
        scores = [metrics.roc_auc(fit(rows.where(F.col("fold") != k), ["a", "b"], "y", **c).predict(rows.where(F.col("fold") == k))).first()[0] for k in range(2)]
        means.append(sum(scores) / 2)
    assert best == pytest.approx(max(means)) and params == tried[int(np.argmax(means))]
