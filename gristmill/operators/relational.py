"""Relational building blocks.  "First" always means first by explicit order columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DecimalType, MapType, NumericType, StringType, StructType

from ..functions.text import unless_blank
from ..sources.tables import with_rank
from .quantiles import quantiles

Order = Sequence[str | Column]


def keep_first(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """The whole first row of each key; null keys are one group."""
    n = "__first"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def first_row(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """``keep_first`` as one aggregation, for a single order expression: partial results keep a hot key small."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, *(F.col("__row").getField(c).alias(c) for c in rest)).select(*df.columns)


def first_non_null(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Column) -> DataFrame:
    """Per group and column the first value that isn't null; rows with a null key are dropped."""
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*aggs)


def suffixed(df: DataFrame, keys: Sequence[str], taken: Sequence[str], suffix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(c + suffix if c in taken and c not in keys else c) for c in df.columns))


def join_features(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str, how: str = "inner") -> DataFrame:
    """Equi-join; columns of the right that the left has too get ``suffix``.  Repeated keys fan out."""
    return left.join(suffixed(right, keys, left.columns, suffix), list(keys), how)


def left_join_first(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Order, suffix: str) -> DataFrame:
    """Left join after the right side is cut to its first row a key, so no row fans out."""
    return join_features(left, keep_first(right, keys, order), keys, suffix, "left")


def union_first(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of parts, the first row of each key: earlier parts first, then ``order``."""
    whole = None
    for i, part in enumerate(parts):
        part = part.withColumn("__part", F.lit(i))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return keep_first(whole, keys, ["__part", *order]).drop("__part")


def backfill(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join that fills blank text columns of the left from the right; a column the left lacks comes whole."""
    have = [c for c in columns if c in left.columns]
    right = right.select(*keys, *(F.col(c).alias(f"__{c}" if c in have else c) for c in columns))
    joined = left.join(right, list(keys), "left")
    return joined.withColumns({c: unless_blank(F.col(c), F.col(f"__{c}")) for c in have}).drop(*(f"__{c}" for c in have))


def compute_once(df: DataFrame, keys: Sequence[str], compute) -> DataFrame:
    """Applies ``compute`` to the distinct keys and joins its columns back; null keys match."""
    made = compute(df.select(*keys).distinct())
    made = made.select(*(F.col(k).alias("__k_" + k) for k in keys), *(c for c in made.columns if c not in keys))
    on = [df[k].eqNullSafe(made["__k_" + k]) for k in keys]
    return df.join(made, on, "left").drop(*("__k_" + k for k in keys))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``value`` by ``key``; a row without a match fails the query."""
    found = df.join(table.select(key, value), key, "left")
    error = F.raise_error(F.concat(F.lit(f"no {value} for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.withColumn(value, F.when(F.col(value).isNull(), error.cast(table.schema[value].dataType)).otherwise(F.col(value)))


def unmatched(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys in one of the two only, with the side that has them."""
    left = a.select(*keys).distinct().join(b, list(keys), "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select(*keys).distinct().join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` in both; empty for groups that don't leak."""
    return a.select(key).dropna().intersect(b.select(key).dropna())


def top_pairs(df: DataFrame, item: str, score: str, k: int) -> DataFrame:
    """All pairs i < j of the k best items, by rank; k bounds the rows."""
    order = Window.orderBy(F.desc(score), item)
    top = df.orderBy(F.desc(score), item).limit(k).select(item, score, F.row_number().over(order).alias("rank"))
    a, b = (top.select(*(F.col(c).alias(f"{c}_{s}") for c in top.columns)) for s in ("a", "b"))
    return a.join(b, F.col("rank_a") < F.col("rank_b"))


def median_fill(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Nulls and NaNs become the exact median of the column, of ``fit_on`` if given; an all-null column stays."""
    if not columns:
        return df
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    fit_on = df if fit_on is None else fit_on
    found = quantiles(fit_on, {c: clean(c) for c in columns}, [0.5])
    medians = found.agg(*(F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(f"__{c}") for c in columns))
    out = df.crossJoin(F.broadcast(medians))  # one row
    return out.withColumns({c: F.coalesce(clean(c), F.col(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns of more than one value, null being one, found in one pass without counting them all."""
    tests = [((F.min(c) != F.max(c)) | (F.max(F.col(c).isNull()) & F.max(F.col(c).isNotNull()))).alias(c) for c in columns]
    row = df.agg(*tests).first() if columns else {}
    return [c for c in columns if row[c]]


def feature_columns(df: DataFrame, prefixes: Sequence[str] = ("prompt_", "repo_", "patch_")) -> list[str]:
    return [f.name for f in df.schema if f.name.startswith(tuple(prefixes)) and isinstance(f.dataType, NumericType)]


def prefixed(df: DataFrame, prefixes: Sequence[str], also: Sequence[str]) -> DataFrame:
    return df.select(*(c for c in df.columns if c in also or c.startswith(tuple(prefixes))))


def front(df: DataFrame, *groups: Sequence[str]) -> DataFrame:
    """The columns of the groups that exist, in order, then the rest."""
    first = [c for g in groups for c in g if c in df.columns]
    return df.select(*dict.fromkeys(first), *(c for c in df.columns if c not in first))


def not_in(c: Column, values: Sequence[str]) -> Column:
    """NOT IN that keeps nulls."""
    return c.isNull() | ~c.isin(*values) if values else F.lit(True)


def flag_on(c: Column) -> Column:
    """Numeric value other than 0; text that is no number counts as 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0)) != 0


def at_least(c: Column, least: float) -> Column:
    """1 or 0; null and NaN are 0."""
    return F.coalesce(F.when(~F.isnan(c.cast("double")), (c >= least).cast("int")), F.lit(0))


def target_kind(df: DataFrame, column: str) -> str:
    """"binary", "multiclass" or "continuous": whole values are classes."""
    row = df.agg(F.count_distinct(column).alias("n"), F.max(F.col(column).cast("double") != F.floor(F.col(column).cast("double"))).alias("parts")).first()
    return "continuous" if row.parts else "binary" if row.n <= 2 else "multiclass"


def shard(df: DataFrame, order: Order, index: int, shards: int, max_rows: int | None = None) -> DataFrame:
    """The index-th of contiguous shards of ceil(n / shards) rows by ``order``, then its first ``max_rows``."""
    if shards < 1 or not 0 <= index < shards:
        raise ValueError(f"shard {index} of {shards}")
    size = -(-df.count() // shards)
    n = "__n"
    out = with_rank(df, [], order, n).withColumn(n, F.col(n) - 1).where((F.col(n) >= index * size) & (F.col(n) < (index + 1) * size))
    if max_rows is not None:
        out = out.where(F.col(n) < index * size + max_rows)
    return out.drop(n)


def ordered_distinct(df: DataFrame, column: str, order: Column) -> DataFrame:
    """Distinct values by first appearance."""
    return df.groupBy(column).agg(F.min(order).alias("first_at"))


def without_zero_importance(df: DataFrame, importance: DataFrame, feature: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """The table without the columns whose mean absolute importance is 0; columns in ``keep``, and those that ``importance``
    doesn't name, stay.  One row a column is collected."""
    gone = {r[0] for r in importance.groupBy(feature).agg(F.max(F.abs(F.col(value))).alias("m")).where("m = 0").select(feature).collect()}
    return df.select(*(c for c in df.columns if c in keep or c not in gone))


def preselected(effects: DataFrame, columns: Sequence[str], feature: str, size: str, n: int) -> DataFrame:
    """The ``n`` features of the greatest absolute effect, ties by name, that are among ``columns``, with their place."""
    top = effects.orderBy(F.desc_nulls_last(F.abs(F.col(size))), feature).limit(n)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(F.abs(F.col(size))), feature))  # n rows
    return top.withColumn("place", place).where(F.col(feature).isin(*columns) if columns else F.lit(False))


def capped_pairs(df: DataFrame, a: str, b: str, most: int | None = None) -> DataFrame:
    """Distinct pairs in order, the first ``most`` of them."""
    pairs = df.select(a, b).distinct().orderBy(a, b)
    return pairs if most is None else pairs.limit(most)


def row_json(df: DataFrame, out: str = "row_json") -> DataFrame:
    """Each row as one JSON object, nulls kept; types that JSON lacks become text."""

    def plain(name: str, kind) -> Column:
        own = isinstance(kind, (NumericType, StringType, BooleanType, StructType, ArrayType, MapType)) and not isinstance(kind, DecimalType)
        return (F.col(f"`{name}`") if own else F.col(f"`{name}`").cast("string")).alias(name)

    return df.select(F.to_json(F.struct(*(plain(f.name, f.dataType) for f in df.schema)), {"ignoreNullFields": "false"}).alias(out))
