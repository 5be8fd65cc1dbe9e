"""Ranking: top rows, average ranks, difficulty bands, running state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import running_sums, with_rank
from .quantiles import quantiles


def top_by_size(df: DataFrame, score: str, n: int | None, tie: str) -> DataFrame:
    """Rows of the greatest absolute score, all for ``n`` None; nulls last."""
    out = df.orderBy(F.desc_nulls_last(F.abs(F.col(score))), tie)
    return out if n is None else out.limit(n)


def top_per_row(df: DataFrame, row: str, values: str, k: int) -> DataFrame:
    """(row, pos, value, rank): the k components of the greatest size of an array, ties to the lower position."""
    order = F.transform(values, lambda x, i: F.struct((-F.abs(x)).alias("size"), i.alias("pos"), x.alias("value")))
    return df.select(row, F.posexplode(F.slice(F.array_sort(order), 1, k)).alias("r", "x")).select(row, "x.pos", "x.value", (F.col("r") + 1).alias("rank"))


def extremes(df: DataFrame, score: str, pos: str, n: int) -> DataFrame:
    """The n highest and n lowest rows, ties to earlier rows on both sides."""
    high = df.orderBy(F.desc(score), pos).limit(n).withColumn("side", F.lit("high"))
    low = df.orderBy(score, pos).limit(n).withColumn("side", F.lit("low"))
    return high.unionByName(low)


def nearest(df: DataFrame, score: str, pos: str, n: int, centre: str | float = "mean") -> DataFrame:
    """The n rows nearest to the mean, the median or a number, ties to earlier rows."""
    if centre == "median":
        at = quantiles(df, {"c": F.col(score)}, [0.5]).select(F.col("q")[0].alias("__c"))  # one row
    else:
        at = df.agg((F.avg(score) if centre == "mean" else F.max(F.lit(centre))).cast("double").alias("__c"))  # one row
    dist = F.abs(F.col(score) - F.col("__c"))
    return df.crossJoin(F.broadcast(at)).withColumn("distance", dist).orderBy("distance", pos).limit(n).drop("__c")


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Descending rank, ties share their mean rank, nulls get none: counts of distinct values are summed by ranges and
    joined back, so no task holds the table."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("__c"))
    upto = running_sums(counts, [-F.col("__value").cast("double")], {"__upto": F.col("__c")})
    ranks = upto.select("__value", (F.col("__upto").cast("double") - (F.col("__c") - 1).cast("double") / F.lit(2.0)).alias(out))
    return df.join(ranks, df[column] == ranks["__value"], "left").drop("__value")


def consistency(a: DataFrame, b: DataFrame, key: str, value: str, names: tuple[str, str]) -> DataFrame:
    """Full outer join of two importance tables with average ranks and their difference."""
    x, y = (t.select(key, F.col(value).alias(f"{value}_{n}")) for t, n in zip((a, b), names))
    both = x.join(y, key, "outer")
    for n in names:
        both = average_rank(both, f"{value}_{n}", f"rank_{n}")
    return both.withColumn("rank_delta", F.col(f"rank_{names[0]}") - F.col(f"rank_{names[1]}"))


def bands(df: DataFrame, score: str, pos: str, tail: float = 0.10, mid: float = 0.05, floor: bool = False) -> DataFrame:
    """difficulty_band: the lowest round(tail * n) rows are "hard", as many of the highest "easy" (of ties the
    later), else "mid_band" within ``mid`` of the mean, else "other".  A tail of no rows bands none.  With ``floor`` a tail is
    cut to whole rows, not rounded."""
    n = df.agg(F.count(F.lit(1)).alias("__n"), F.avg(score).alias("__mean"))  # one row
    rows = with_rank(df, [], [score, pos], "__r").crossJoin(F.broadcast(n))
    size = F.floor(F.lit(tail) * F.col("__n") + 1e-9) if floor else F.bround(F.lit(tail) * F.col("__n"), 0).cast("long")
    band = (
        F.when((size > 0) & (F.col("__r") > F.col("__n") - size), "easy").when((size > 0) & (F.col("__r") <= size), "hard")
        .when(F.abs(F.col(score) - F.col("__mean")) <= mid, "mid_band").otherwise("other")
    )
    return rows.withColumn("difficulty_band", band).drop("__r", "__n", "__mean")


def adjacent(df: DataFrame, keys: Sequence[str], order: str, measure, column: str) -> DataFrame:
    """Per group mean and least of ``measure`` between each row and the next; 0.0 without a pair."""
    following = F.lead(column).over(Window.partitionBy(*keys).orderBy(order))
    pairs = df.withColumn("__next", following).withColumn("__m", F.when(F.col("__next").isNotNull(), measure(F.col(column), F.col("__next"))))
    return pairs.groupBy(*keys).agg(F.coalesce(F.avg("__m"), F.lit(0.0)).alias("mean"), F.coalesce(F.min("__m"), F.lit(0.0)).alias("min"))


def filled(df: DataFrame, keys: Sequence[str], order: str, column: Column, out: str) -> DataFrame:
    """The last value that isn't null, up to and with each row."""
    return df.withColumn(out, F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def running_before(df: DataFrame, keys: Sequence[str], order: str, amount: Column, out: str) -> DataFrame:
    """The sum of ``amount`` over earlier rows of the group."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(amount).over(w), F.lit(0)))
