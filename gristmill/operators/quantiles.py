"""Exact quantiles by distributed selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import with_range


def finite(c: Column) -> Column:
    """``c`` as a double, null where it is null, NaN or infinite."""
    x = c.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def quantiles(df: DataFrame, columns: Mapping[str, Column], at: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Per group of ``keys`` and name in ``columns``: ``n`` values that aren't null, and ``q``, their quantiles ``at``
    (linear between neighbours, as numpy's default).

    A selection instead of a buffer a group: rows are counted by ranges of (group, name, value), the ranges that hold a
    wanted rank are found from the counts, and only their rows are shuffled, as counts of distinct values.  Hot groups
    span many ranges and hot values are one row, so nothing grows with a group.  Null keys are a group; groups without
    a value don't appear.  ``df`` is read three times.
    """
    groups = [f"__g{i}" for i in range(len(keys))]
    named = F.array(*(F.struct(F.lit(n).alias("column"), c.cast("double").alias("value")) for n, c in columns.items()))
    long = df.select(*(F.col(f"`{k}`").alias(g) for k, g in zip(keys, groups)), F.inline(named)).where("value IS NOT NULL")
    own = [*groups, "column"]
    rows = with_range(long, [*own, "value"]).drop("__key")
    counts = rows.groupBy(*own, "__range").agg(F.count(F.lit(1)).alias("here"))
    group = Window.partitionBy(*own)  # a row a range in each
    upto = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"n": F.sum("here").over(group), "first": F.sum("here").over(upto) - F.col("here")})
    place = lambda i: (F.col("n") - 1) * F.lit(float(at[i]))
    ranks = F.array(*(F.struct(F.lit(2 * i + up).alias("slot"), (F.ceil(place(i)) if up else F.floor(place(i))).alias("rank")) for i in range(len(at)) for up in (0, 1)))
    wanted = counts.select(*own, "__range", "n", "first", F.inline(ranks)).where("rank >= first AND rank < first + here")
    other = wanted.select(*(F.col(c).alias(f"__w{i}") for i, c in enumerate([*own, "__range"])), "n", "slot", (F.col("rank") - F.col("first")).alias("rank"))

    def same(left: DataFrame, right: DataFrame) -> Column:
        on = left["__range"] == right[f"__w{len(own)}"]
        for i, c in enumerate(own):
            on = on & left[c].eqNullSafe(right[f"__w{i}"])
        return on

    asked = other.select(*(f"__w{i}" for i in range(len(own) + 1))).distinct()
    held = rows.join(asked, same(rows, asked), "left_semi").groupBy(*own, "__range", "value").agg(F.count(F.lit(1)).alias("c"))
    inside = Window.partitionBy(*own, "__range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("last", F.sum("c").over(inside))
    hits = held.join(other, same(held, other) & (F.col("rank") < F.col("last")) & (F.col("rank") >= F.col("last") - F.col("c")))
    slot = lambda k: F.max(F.when(F.col("slot") == k, F.col("value")))
    share = lambda i: (F.max("n") - 1) * F.lit(float(at[i])) - F.floor((F.max("n") - 1) * F.lit(float(at[i])))
    q = F.array(*(slot(2 * i) + F.when(share(i) > 0, (slot(2 * i + 1) - slot(2 * i)) * share(i)).otherwise(0.0) for i in range(len(at))))
    out = hits.groupBy(*own).agg(F.max("n").alias("n"), q.alias("q"))
    return out.select(*(F.col(g).alias(k) for g, k in zip(groups, keys)), "column", "n", "q")
