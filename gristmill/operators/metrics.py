"""Exact metrics of predictions: columns y (0 or 1, or a number) and p."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..sources.tables import running_sums
from .quantiles import quantiles


def _curve(df: DataFrame, y: str, p: str, keys: Sequence[str]) -> DataFrame:
    """Per group and distinct score, descending: true and false positives when it is the threshold, and the totals.

    One row a score leaves the aggregation; running sums go by ranges of scores in parallel.
    """
    points = df.groupBy(*keys, F.col(p).alias("threshold")).agg(F.sum(F.col(y).cast("long")).alias("t"), F.sum(1 - F.col(y).cast("long")).alias("f"))
    return running_sums(points, [-F.col("threshold").cast("double")], {"tp": F.col("t"), "fp": F.col("f")}, keys, {"tp": "pos", "fp": "neg"})


def _area() -> Column:
    # a negative at this score is beaten by positives above it, and by half of those at it
    area = F.sum(F.col("f") * (F.col("tp") - F.col("t") / F.lit(2.0)))
    return F.when((F.max("pos") > 0) & (F.max("neg") > 0), area / (F.max("pos").cast("double") * F.max("neg"))).alias("roc_auc")


def _precision() -> Column:
    gained = (F.col("t").cast("double") / F.col("pos")) * (F.col("tp").cast("double") / (F.col("tp") + F.col("fp")))
    return F.sum(F.when(F.col("pos") > 0, gained)).alias("average_precision")


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney, per group of ``keys``: ties count half; null with one class only."""
    return _curve(df, y, p, keys).groupBy(*keys).agg(_area())


def average_precision(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """Sum over distinct scores of recall gained times precision; not the trapezoid."""
    return _curve(df, y, p, keys).groupBy(*keys).agg(_precision())


def ranking_scores(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """``roc_auc`` and ``average_precision`` of all groups, from one curve."""
    return _curve(df, y, p, keys).groupBy(*keys).agg(_area(), _precision())


def brier(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))


def confusion(df: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    """Counts, F1 (0 without positives) and Matthews' coefficient (0 when degenerate) at a threshold."""
    hit, real = F.col(p) >= threshold, F.col(y) == 1
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    c = df.agg(count(hit & real).alias("tp"), count(hit & ~real).alias("fp"), count(~hit & real).alias("fn"), count(~hit & ~real).alias("tn"))
    d = {k: F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn")}
    f1 = ratio(2 * d["tp"], 2 * d["tp"] + d["fp"] + d["fn"])
    scale = F.sqrt((d["tp"] + d["fp"]) * (d["tp"] + d["fn"]) * (d["tn"] + d["fp"]) * (d["tn"] + d["fn"]))
    return c.withColumns({"f1": f1, "mcc": ratio(d["tp"] * d["tn"] - d["fp"] * d["fn"], scale)})


def regression(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R2 (null when y is constant), per group of ``keys``."""
    e = F.col(p) - F.col(y)
    r2 = 1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))
    return df.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), r2.alias("r2"))


def roc_points(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """threshold, fpr, tpr: one row per distinct score (and group)."""
    c = _curve(df, y, p, keys)
    return c.select(*keys, "threshold", ratio(F.col("fp"), F.col("neg")).alias("fpr"), ratio(F.col("tp"), F.col("pos")).alias("tpr"))


def youden(df: DataFrame, y: str = "y", p: str = "p", legacy_offset: bool = False) -> DataFrame:
    """The threshold of the greatest tpr - fpr, of ties the highest; ``legacy_offset`` takes the next stricter one."""
    points = roc_points(df, y, p).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = points.orderBy(F.desc("j"), F.desc("threshold")).limit(1).select("threshold", "j")
    if not legacy_offset:
        return best
    above = df.select(F.col(p).alias("__s")).crossJoin(F.broadcast(best.select(F.col("threshold").alias("__t")))).where("__s > __t")  # one row
    return best.crossJoin(F.broadcast(above.agg(F.min("__s").alias("__next")))).select(F.coalesce("__next", "threshold").alias("threshold"), "j")


def calibration(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Quantile bins of p (a bin is the number of cuts below p): mean_pred, frac_pos and n of those with rows."""
    cuts = quantiles(df, {"cuts": F.col(p)}, [i / bins for i in range(1, bins)]).select(F.col("q").alias("__cuts"))  # one row
    bin_of = F.size(F.filter("__cuts", lambda c: c < F.col(p)))
    return df.crossJoin(F.broadcast(cuts)).groupBy(bin_of.alias("bin")).agg(F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("frac_pos"), F.count(F.lit(1)).alias("n"))


def majority_baseline(train: DataFrame, test: DataFrame, y: str = "y") -> DataFrame:
    """``test`` with p the share of positives in ``train``."""
    return test.crossJoin(F.broadcast(train.agg(F.avg(F.col(y).cast("double")).alias("p"))))


def fold_summary(df: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """Mean and population deviation over folds; NaNs are skipped."""
    x = F.when(~F.isnan(F.col(metric)), F.col(metric))
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
