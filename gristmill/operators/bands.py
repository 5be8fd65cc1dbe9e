"""Attribution profiles per task and summaries by difficulty band, over arrays of attributions."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio, ratio_or_null
from .quantiles import quantiles
from .ranking import bands, top_per_row
from .rollup import grid_summary

QUANTITIES = ("net_shap", "max_struct_abs_shap", "sum_struct_abs_shap", "max_prompt_abs_shap", "sum_prompt_abs_shap", "prompt_struct_max_ratio")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def profile(df: DataFrame, phi: str, prompt: Sequence[int], top: int = 5) -> DataFrame:
    """Adds per row: the net attribution, greatest and summed sizes of prompt and other features, the ratio of
    the greatest (null where the other is 0), and how many of the ``top`` largest are prompt features."""
    inside = F.array(*(F.lit(i) for i in prompt)) if prompt else F.array().cast("array<int>")
    values = F.col(phi)
    sizes = lambda keep: F.transform(F.filter(F.transform(values, lambda x, i: F.struct(i.alias("i"), F.abs(x.cast("double")).alias("a"))), lambda s: F.array_contains(inside, s["i"]) == F.lit(keep)), lambda s: s["a"])
    order = F.array_sort(F.transform(values, lambda x, i: F.struct((-F.abs(x)).alias("size"), i.alias("pos"))))
    mine, other = sizes(True), sizes(False)
    out = df.withColumns({
        "net_shap": _sum(F.transform(values, lambda x: x.cast("double"))), "max_struct_abs_shap": F.coalesce(F.array_max(other), F.lit(0.0)), "sum_struct_abs_shap": _sum(other),
        "max_prompt_abs_shap": F.coalesce(F.array_max(mine), F.lit(0.0)), "sum_prompt_abs_shap": _sum(mine),
        "n_prompt_in_top5": F.size(F.filter(F.slice(order, 1, top), lambda s: F.array_contains(inside, s["pos"]))),
    })
    return out.withColumn("prompt_struct_max_ratio", ratio_or_null(F.col("max_prompt_abs_shap"), F.col("max_struct_abs_shap")))


def chance(prompt: int = 27, features: int = 54, top: int = 5) -> float:
    """The chance that ``top`` features drawn at random hold a prompt feature."""
    return 1 - comb(features - prompt, top) / comb(features, top)


def stratified(df: DataFrame, level: float) -> DataFrame:
    """Per subset (all, correct) and band: n, prediction range, hits (a prompt feature in the top), their rate and its
    distance from chance, and mean and median of the profile's quantities.  Empty groups appear with n 0."""
    spark = df.sparkSession
    both = df.withColumn("subset", F.explode(F.when(F.col("correct"), F.array(F.lit("all"), F.lit("correct"))).otherwise(F.array(F.lit("all")))))
    grid = spark.createDataFrame([(s, b) for s in ("all", "correct") for b in ("easy", "mid_band", "hard")], "subset string, difficulty_band string")
    hit = (F.col("n_prompt_in_top5") > 0).cast("int")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("score").alias("score_mean"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.sum(hit).alias("hits")]
    for q in QUANTITIES:
        aggs.append(F.avg(q).alias(f"{q}_mean"))
    keys = ["subset", "difficulty_band"]
    out = grid_summary(both, grid, keys, aggs, ["n", "hits"])
    medians = quantiles(both, {q: F.col(q) for q in QUANTITIES}, [0.5], keys)
    medians = medians.groupBy(*keys).agg(*(F.max(F.when(F.col("column") == q, F.col("q")[0])).alias(f"{q}_median") for q in QUANTITIES))
    out = out.join(medians, keys, "left")
    return out.withColumn("hit_rate", ratio(F.col("hits"), F.col("n"))).withColumn("over_chance", F.col("hit_rate") - F.lit(level))


def feature_counts(df: DataFrame, row: str, phi: str, catalog: DataFrame, k: int = 5) -> DataFrame:
    """How often each feature of ``catalog`` (pos, feature) is among the k largest of a row, and its share of rows."""
    n = df.agg(F.count(F.lit(1)).alias("rows"))  # one row
    hits = top_per_row(df, row, phi, k).groupBy("pos").agg(F.count(F.lit(1)).alias("hits"))
    out = catalog.join(hits, "pos", "left").na.fill(0, ["hits"]).crossJoin(F.broadcast(n))
    return out.select("feature", "hits", ratio(F.col("hits"), F.col("rows")).alias("share"))


__all__ = ["QUANTITIES", "bands", "chance", "feature_counts", "profile", "stratified"]
