"""Splits and folds by hash order: the same rows whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import with_rank


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def train_test(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """split: in each class, the ceil(test_share * n) rows of the smallest hashes are "test"."""
    ranked = with_rank(df, [label], [hash_order(key, seed), key], "__rank", "__size")
    share = F.ceil(F.col("__size") * test_share)
    return ranked.withColumn("split", F.when(F.col("__rank") <= share, "test").otherwise("train")).drop("__rank", "__size")


def group_split(df: DataFrame, group: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """split by groups: all rows of a group on one side; by its hash, so groups keep their side as others come."""
    share = F.conv(F.left(hash_order(group, seed), F.lit(8)), 16, 10).cast("double") / F.lit(float(16**8))
    return df.withColumn("split", F.when(share < test_share, "test").otherwise("train"))


def folds(df: DataFrame, key: str, k: int, seed: int = 42, within: Sequence[str] = ()) -> DataFrame:
    """fold 0 to k-1 in turn by hash order; ``within`` makes it stratified."""
    ranked = with_rank(df, within, [hash_order(key, seed), key], "__rank")
    return ranked.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank")


def group_folds(df: DataFrame, group: str, k: int, seed: int = 42) -> DataFrame:
    """fold of each row's group, groups dealt in turn by hash order."""
    g = folds(df.select(group).distinct(), group, k, seed)
    return df.join(g, group)


def inner_folds(n: int, *, groups: int | None = None, smallest_class: int | None = None, rows: int | None = None) -> int:
    """How many inner folds the data allow, two at least."""
    limits = [n, *([groups - 1] if groups is not None else []), *([smallest_class] if smallest_class is not None else []), *([rows // 4] if rows is not None else [])]
    return max(2, min(limits))


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 42, largest: int = 5_000) -> DataFrame:
    """fold 0 to k-1 of each row, groups whole, classes spread evenly.

    Groups, the most uneven in their class counts first, go in turn to the fold where the classes' shares over folds then deviate
    least, of ties to the fold of fewest rows.  The ``largest`` groups are placed one by one; smaller ones are bundled by
    hash into as many bundles, which are placed like groups, so that the driver holds 2 ``largest`` times the classes
    numbers whatever the table.  Null groups are one group, null labels one class.
    """
    counts = df.groupBy(F.col(group).alias("g"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("g").agg(F.sum("n").alias("size"))
    big = sizes.orderBy(F.desc("size"), F.col("g").cast("string")).limit(largest).select(F.col("g").alias("big"), F.lit(True).alias("own"))
    named = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("g").cast("string")), F.lit("null")), F.lit(f"|{seed}")))
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64(named), F.lit(largest)).cast("string"))
    units = counts.join(F.broadcast(big), F.col("g").eqNullSafe(F.col("big")), "left")  # ``largest`` rows
    units = units.withColumn("unit", F.when(F.col("own"), F.concat(F.lit("g"), named)).otherwise(bundle))
    held: dict[str, dict] = {}
    for r in units.groupBy("unit", "y").agg(F.sum("n").alias("n")).collect():
        held.setdefault(r.unit, {})[r.y] = r.n
    fold_of = _placed(held, k)
    places = df.sparkSession.createDataFrame(sorted(fold_of.items()), "unit string, fold int")
    of_group = units.select("g", "unit").distinct().join(F.broadcast(places), "unit").select(F.col("g").alias("__group"), "fold")
    return df.join(of_group, df[group].eqNullSafe(of_group["__group"])).drop("__group")


def _placed(units: dict[str, dict], k: int) -> dict[str, int]:
    """Units with their class counts to folds, by the greedy rule above."""
    classes = sorted({y for c in units.values() for y in c}, key=repr)
    names = sorted(units)
    counts = np.array([[units[u].get(y, 0) for y in classes] for u in names], float).reshape(len(names), len(classes))
    whole = np.maximum(counts.sum(0), 1)
    folds, rows, out = np.zeros((k, len(classes))), np.zeros(k), {}
    for i in np.lexsort((np.arange(len(names)), -counts.std(1))):
        spread = [np.std((folds + np.outer(np.arange(k) == f, counts[i])) / whole, axis=0).mean() for f in range(k)]
        best = min(range(k), key=lambda f: (round(spread[f], 12), rows[f], f))
        folds[best] += counts[i]
        rows[best] += counts[i].sum()
        out[names[i]] = int(best)
    return out
