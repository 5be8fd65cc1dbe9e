"""Second-order gradient boosting over histograms.

Features are binned once by exact quantiles and the binned rows staged.  A level of a tree is one aggregation: gradient and Hessian
sums by (node, feature, bin), combined before they are shuffled, and the best split of each node by windows over bins; the driver
gets a row a node.  Trees are column expressions, so rows are scored in generated code.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch
from .quantiles import quantiles


def value_of(feature: str) -> Column:
    """A feature as a double; null and NaN are 0."""
    x = F.col(f"`{feature}`").cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(0.0)


def cut_points(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Distinct quantiles of each feature, ``bins`` - 1 at most: what the driver holds is bounded by features times bins."""
    found = quantiles(df, {f: value_of(f) for f in features}, [i / bins for i in range(1, bins)]).collect()
    cuts = {r["column"]: sorted(set(r["q"])) for r in found}
    return {f: cuts.get(f, []) for f in features}


def bin_of(feature: str, cuts: Sequence[float]) -> Column:
    """How many cut points lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value_of(feature))) if cuts else F.lit(0)


def histograms(rows: DataFrame, node: Column, features: Sequence[int]) -> DataFrame:
    """node, feature, bin: sums of g and h, and n.  ``rows`` has g, h and bins b0, b1, ...; a null node takes no part."""
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"b{f}").alias("bin")) for f in features))
    long = rows.select(node.alias("node"), "g", "h", F.explode(each).alias("x")).where("node IS NOT NULL")
    return long.groupBy("node", "x.feature", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))


def split_gains(hist: DataFrame, l2: float, min_child: float) -> DataFrame:
    """Adds for each bin the split "bin or less": sums of both sides and gain, null where a side's Hessian is less than
    ``min_child`` or has no rows.  A window holds the bins of one feature of one node."""
    one = Window.partitionBy("node", "feature")
    upto = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    out = hist.withColumns({"gl": F.sum("g").over(upto), "hl": F.sum("h").over(upto), "nl": F.sum("n").over(upto), "gt": F.sum("g").over(one), "ht": F.sum("h").over(one), "nt": F.sum("n").over(one)})
    out = out.withColumns({"gr": F.col("gt") - F.col("gl"), "hr": F.col("ht") - F.col("hl")})
    term = lambda g, h: F.col(g) * F.col(g) / (F.col(h) + F.lit(float(l2)))
    able = (F.col("nl") < F.col("nt")) & (F.col("hl") >= min_child) & (F.col("hr") >= min_child)
    return out.withColumn("gain", F.when(able, F.lit(0.5) * (term("gl", "hl") + term("gr", "hr") - term("gt", "ht"))))


def best_splits(gains: DataFrame) -> DataFrame:
    """A row per node: its sums, and the split of the greatest gain (to 12 digits), of ties the least feature and bin."""
    found = F.max_by(F.struct("feature", "bin", "gain", "gl", "hl", "gr", "hr"), F.when(F.col("gain").isNotNull(), F.struct(F.round("gain", 12), -F.col("feature"), -F.col("bin"))))
    return gains.groupBy("node").agg(F.max("gt").alias("gt"), F.max("ht").alias("ht"), found.alias("split"))


@dataclass
class Tree:
    """Nodes by number, children of node k are 2 k + 1 and 2 k + 2: (feature, bin) of inner nodes, values of leaves."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def expression(self, test, leaf, node: int = 0) -> Column:
        if node not in self.splits:
            return leaf(node)
        feature, at = self.splits[node]
        return F.when(test(feature, at), self.expression(test, leaf, 2 * node + 1)).otherwise(self.expression(test, leaf, 2 * node + 2))


@dataclass
class Boosted:
    """A fitted ensemble: its margin is ``base`` plus the trees' values."""

    features: list[str]
    cuts: dict[str, list[float]]
    kind: str
    base: float
    trees: list[Tree]
    gains: dict[str, float]

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Adds the probability of class 1, or the value limited to 0 and 1."""
        test = lambda f, at: value_of(self.features[f]) <= F.lit(self.cuts[self.features[f]][at])
        margin = F.lit(self.base)
        for tree in self.trees:
            margin = margin + tree.expression(test, lambda k, t=tree: F.lit(t.values[k]))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)) if self.kind == "classification" else F.greatest(F.lit(0.0), F.least(F.lit(1.0), margin))
        return df.withColumn(out, p)

    def importances(self) -> dict[str, float]:
        """Shares of the whole gain."""
        whole = sum(self.gains.values())
        return {f: self.gains.get(f, 0.0) / whole if whole else 0.0 for f in self.features}


def gradients(kind: str, margin: str = "margin", y: str = "y") -> dict[str, Column]:
    if kind == "classification":
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(margin)))
        return {"g": p - F.col(y), "h": p * (F.lit(1.0) - p)}
    return {"g": F.col(margin) - F.col(y), "h": F.lit(1.0)}


def boost(
    df: DataFrame, features: Sequence[str], label: str, kind: str = "classification", key: str | None = None, trees: int = 100, depth: int = 4, rate: float = 0.05, bins: int = 64, l2: float = 1.0,
    min_child: float = 1.0, min_gain: float = 0.0, rows: float = 1.0, columns: float = 1.0, seed: int = 42, stage_every: int = 10,
) -> Boosted:
    """Fits ``trees`` trees.  Each takes the share ``columns`` of the features and the share ``rows`` of the rows, by a hash of
    ``key`` (of all features without one); rows without a label take no part.  Margins are staged every ``stage_every`` trees, which
    cuts lineage.  A leaf's value is -rate * G / (H + l2)."""
    spark = df.sparkSession
    labelled = df.where(F.col(label).isNotNull())
    cuts = cut_points(labelled, features, bins)
    mean = labelled.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if mean is None:
        raise ValueError("no row has a label")
    base = log(min(max(mean, 1e-6), 1 - 1e-6) / (1 - min(max(mean, 1e-6), 1 - 1e-6))) if kind == "classification" else mean
    by = F.xxhash64(F.col(f"`{key}`")) if key else F.xxhash64(*(value_of(f) for f in features))
    data = labelled.select(by.alias("row"), F.col(label).cast("double").alias("y"), F.lit(base).alias("margin"), *(bin_of(f, cuts[f]).alias(f"b{i}") for i, f in enumerate(features)))
    data = _staged(spark, data)
    test = lambda f, at: F.col(f"b{f}") <= at
    made, gains = [], {}
    for t in range(trees):
        mine = sorted(random.Random(f"{seed}-{t}").sample(range(len(features)), max(1, round(columns * len(features)))))
        part = data if rows >= 1 else data.where(F.pmod(F.xxhash64("row", F.lit(seed), F.lit(t)), F.lit(1_000_000)) < int(rows * 1_000_000))
        part = part.withColumns(gradients(kind))
        tree = Tree()
        for level in range(depth):
            first = (1 << level) - 1
            if level and not any(k in tree.splits for k in range((1 << level - 1) - 1, first)):
                break
            at = tree.expression(test, lambda k: F.lit(k if k >= first else None).cast("int"))
            for r in best_splits(split_gains(histograms(part, at, mine), l2, min_child)).collect():
                tree.values.setdefault(r.node, -rate * r.gt / (r.ht + l2))
                if r.split is not None and r.split.gain is not None and r.split.gain > min_gain:
                    tree.splits[r.node] = (r.split.feature, r.split.bin)
                    tree.values[2 * r.node + 1], tree.values[2 * r.node + 2] = -rate * r.split.gl / (r.split.hl + l2), -rate * r.split.gr / (r.split.hr + l2)
                    name = features[r.split.feature]
                    gains[name] = gains.get(name, 0.0) + r.split.gain
        tree.values.setdefault(0, 0.0)
        made.append(tree)
        data = data.withColumn("margin", F.col("margin") + tree.expression(test, lambda k: F.lit(tree.values[k])))
        if (t + 1) % stage_every == 0 and t + 1 < trees:
            data = _staged(spark, data)
    return Boosted(list(features), cuts, kind, base, made, gains)


def _staged(spark, df: DataFrame) -> DataFrame:
    path = scratch(spark, "boosting")
    df.write.parquet(path)
    return spark.read.parquet(path)


def boosted(df: DataFrame, features: Sequence[str], label: str, kind: str = "classification", seed: int = 42, **params: Mapping) -> Boosted:
    """``boost`` with the usual settings, as the searches of ``models`` call it."""
    return boost(df, features, label, kind, **({"trees": 300, "depth": 4, "rate": 0.05, "rows": 0.8, "columns": 0.8, "min_child": 3.0, "seed": seed} | params))
