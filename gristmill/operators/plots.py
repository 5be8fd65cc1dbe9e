"""The data behind plots of attributions and scores: small tables, however many rows there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REST = "others"


def _step(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The number, from 0, of the equal step between ``low`` and ``high``; the greatest value is in the last one."""
    at = F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * bins)
    return F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")


def density(df: DataFrame, keys: Sequence[str], x: str, y: str, bins: int = 50, color: str | None = None) -> DataFrame:
    """Beeswarm, summary and dependence plots: per group and cell of equal steps of ``x`` and ``y`` between the group's least and
    greatest, how many rows and, if given, the mean of ``color``.  Rows with a null or NaN in ``x`` or ``y`` are left out."""
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = df.where(real(x) & real(y)).select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), *([F.col(color).cast("double").alias("__c")] if color else []))
    ends = rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(*(f(c).alias(f"__{n}{c}") for c in ("__x", "__y") for n, f in (("lo", F.min), ("hi", F.max))))
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(ends[f"__{k}"])
    cell = lambda c: _step(F.col(c), F.col(f"__lo{c}"), F.col(f"__hi{c}"), bins)
    cells = rows.join(ends, on).groupBy(*keys, cell("__x").alias("x_bin"), cell("__y").alias("y_bin"))
    return cells.agg(F.count(F.lit(1)).alias("n"), *([F.avg("__c").alias("color")] if color else []))


def waterfall(phi: DataFrame, row: str, feature: str, value: str, base: Column, most: int = 15) -> DataFrame:
    """Waterfalls: per row its strongest features by absolute value (ties by name), from ``start`` to ``end``, on top of the
    sum of the others, which begins at ``base``.  With more than ``most`` features, the last place is the others'."""
    named = phi.select(row, F.col(feature).cast("string").alias("feature"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("phi"), base.alias("base"))
    order = Window.partitionBy(row).orderBy(F.desc(F.abs("phi")), "feature")  # the features of a row
    placed = named.withColumns({"place": F.row_number().over(order), "__n": F.count(F.lit(1)).over(Window.partitionBy(row))})
    rest = (F.col("place") >= most) & (F.col("__n") > most)
    bars = placed.groupBy(row, F.when(rest, most).otherwise(F.col("place")).alias("place")).agg(
        F.when(F.max(rest), F.lit(REST)).otherwise(F.max("feature")).alias("feature"), F.sum("phi").alias("phi"), F.max("base").alias("base"), F.count(F.lit(1)).alias("features")
    )
    below = F.col("base") + F.sum("phi").over(Window.partitionBy(row).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("end", below).select(row, "place", "feature", "features", "phi", (F.col("end") - F.col("phi")).alias("start"), "end")


def partners(pairs: DataFrame, a: str, b: str, strength: str) -> DataFrame:
    """Per feature the one it interacts with most (ties by name), from pairs given once in either order."""
    both = pairs.select(F.col(a).alias("feature"), F.col(b).alias("partner"), F.col(strength).alias("strength"))
    both = both.unionByName(pairs.select(F.col(b).alias("feature"), F.col(a).alias("partner"), F.col(strength).alias("strength")))
    best = F.min_by(F.struct("partner", "strength"), F.struct(-F.col("strength"), F.col("partner")))
    return both.where("feature <> partner").groupBy("feature").agg(best.alias("m")).select("feature", "m.partner", "m.strength")
