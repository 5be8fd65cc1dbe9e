"""Roll-ups: runs to tasks, tasks to groups, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import finite, quantiles
from .relational import at_least, feature_columns, first_non_null, first_row, flag_on, front, join_features, left_join_first, median_fill, not_in, varying


def task_outcomes(runs: DataFrame, task: str = "task_id", reward: Column | None = None) -> DataFrame:
    """Per task: pass_rate, n_runs, n_success, any_success, maj_success.  A run with a reward of at least 1
    succeeds; a null or NaN reward fails.  Rows without a task are dropped."""
    ok = at_least(F.col("reward") if reward is None else reward, 1.0)
    out = runs.where(F.col(task).isNotNull()).groupBy(task).agg(F.avg(ok).alias("pass_rate"), F.count(F.lit(1)).alias("n_runs"), F.sum(ok).alias("n_success"))
    return out.withColumns({"any_success": (F.col("n_success") >= 1).cast("int"), "maj_success": (F.col("pass_rate") >= 0.5).cast("int")})


OUTCOMES = ("pass_rate", "n_runs", "n_success", "any_success", "maj_success")
META = ("trajectory_id", "cf_split", "cf_row_index", "base_repo", "base_patch", "base_base_commit", "base_instance_id")


def task_level(prompt: DataFrame, repo: DataFrame, patch: DataFrame, mapping: DataFrame, order: Column, exclude: Sequence[str] = ()) -> DataFrame:
    """One row per task: meta columns, outcomes and numeric features.

    Joins the three feature tables on ``trajectory_id`` (repeats multiply runs) and the mapping's first
    row, drops rows without a patch and excluded splits, rolls runs up, takes the first row's features,
    drops constant ones and fills nulls by the median of all rows.
    """
    rows = join_features(join_features(prompt, repo, ["trajectory_id"], "_repo"), patch, ["trajectory_id"], "_patch")
    rows = left_join_first(rows, mapping, ["trajectory_id"], ["cf_split", "cf_row_index"] if "cf_split" in mapping.columns else ["trajectory_id"], "_map")
    if "patch_present" in rows.columns:
        rows = rows.where(flag_on(F.col("patch_present")))
    if "cf_split" in rows.columns:
        rows = rows.where(not_in(F.col("cf_split"), exclude))
    outcomes = task_outcomes(rows)
    features = feature_columns(rows)
    first = first_row(rows.where(F.col("task_id").isNotNull()).select("task_id", *features, order.alias("__order")), ["task_id"], F.col("__order")).drop("__order")
    kept = varying(first, features)
    first = median_fill(first.select("task_id", *kept), kept)
    meta = first_non_null(rows, ["task_id"], [c for c in META if c in rows.columns], order)
    return front(first.join(outcomes, "task_id").join(meta, "task_id", "left"), ["task_id", *META], OUTCOMES)


def group_rollup(df: DataFrame, key: str, features: Sequence[str], outcomes: Sequence[str], summed: Sequence[str] = ("n_runs",)) -> DataFrame:
    """Means of features and outcomes, sums of run counts, and the group's size; null keys are dropped."""
    aggs = [F.avg(c).alias(c) for c in (*features, *outcomes)] + [F.sum(c).alias(c) for c in summed]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs, F.count(F.lit(1)).alias("n_tasks"))


def describe(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, median and quartiles of finite values, null where there are none."""
    x = finite(F.col(column))
    means = df.groupBy(*keys).agg(F.avg(x).alias("mean"))
    found = quantiles(df, {column: x}, [0.25, 0.5, 0.75], keys).select(*(F.col(k).alias(f"__{k}") for k in keys), "q")
    on = F.lit(True)
    for k in keys:
        on = on & means[k].eqNullSafe(found[f"__{k}"])
    return means.join(found, on, "left").select(*keys, "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"))


def entropy(df: DataFrame, keys: Sequence[str], weight: str, base: float = 2.0) -> DataFrame:
    """Shannon entropy of positive weights per group; 0 for one item or no weight."""
    w = F.when(F.col(weight) > 0, F.col(weight).cast("double"))
    total, weighed = F.sum(w), F.sum(w * F.log(w))
    whole = F.greatest(F.lit(0.0), (F.log(total) - weighed / total) / F.log(F.lit(float(base))))
    return df.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > 1, F.coalesce(whole, F.lit(0.0))).otherwise(0.0).alias("entropy"))


def gini(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Gini coefficient of the weights per group, zeros included, within 0 and 1; 0 for one item or no weight."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(weight))
    g = df.withColumn("__r", rank).groupBy(*keys).agg(F.sum(F.col("__r") * F.col(weight)).alias("s"), F.sum(weight).alias("t"), F.count(F.lit(1)).alias("n"))
    raw = 2.0 * F.col("s") / (F.col("n") * F.col("t")) - (F.col("n") + 1.0) / F.col("n")
    return g.select(*keys, F.when((F.col("n") > 1) & (F.col("t") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(0.0).alias("gini"))


def largest(df: DataFrame, keys: Sequence[str], item: str, weight: str) -> DataFrame:
    """The item of the greatest weight per group, ties to the least item."""
    return df.groupBy(*keys).agg(F.min_by(item, F.struct(-F.col(weight), F.col(item))).alias(item), F.max(weight).alias(weight))


def mean_gap(df: DataFrame, group: Sequence[str], within: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Mean of max(0, step) between consecutive values within ``group`` and ``within``, per group; 0 without a step."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*group, *within).orderBy(*order))
    return df.withColumn("__gap", F.when(step.isNotNull(), F.greatest(step, F.lit(0)))).groupBy(*group).agg(F.coalesce(F.avg("__gap"), F.lit(0.0)).alias("gap_mean"))


def grid_summary(df: DataFrame, grid: DataFrame, keys: Sequence[str], aggs: Sequence[Column], zero: Sequence[str] = ()) -> DataFrame:
    """Aggregates by the keys of ``grid``; groups without rows appear, with 0 for the columns in ``zero``."""
    out = grid.join(df.groupBy(*keys).agg(*aggs), list(keys), "left")
    return out.na.fill(0, list(zero)) if zero else out


def collisions(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """How many items stand more than once, per group."""
    return df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("__n")).groupBy(*keys).agg(F.sum((F.col("__n") > 1).cast("int")).alias("collisions"))


def reuse(df: DataFrame, keys: Sequence[str], mention: str) -> DataFrame:
    """Share of mentions that repeat another (count - 1 of those above 1), and mean mentions per item."""
    n = df.groupBy(*keys, mention).agg(F.count(F.lit(1)).alias("c")).groupBy(*keys)
    return n.agg((F.sum(F.when(F.col("c") > 1, F.col("c") - 1).otherwise(0)) / F.sum("c")).alias("reuse_ratio"), F.avg("c").alias("chain_len_mean"))


def dataset_summary(tasks: DataFrame, repo: str = "base_repo", source: str = "cf_split") -> tuple[DataFrame, DataFrame]:
    """Counts and means over all tasks, and tasks by source."""
    whole = tasks.agg(F.count(F.lit(1)).alias("n_tasks"), *(F.avg(c).alias(f"{c}_mean") for c in ("pass_rate", "any_success", "maj_success")), F.count_distinct(repo).alias("n_repositories"))
    return whole, tasks.groupBy(source).agg(F.count(F.lit(1)).alias("n_tasks"))
