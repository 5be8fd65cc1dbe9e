"""Sources and sinks: tables by format, snapshots of file trees, manifests, guards."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TREE = "repo string, kind string, commit_sha string, root_tree_sha string, tree_sha string, truncated boolean, tree array<struct<path: string, type: string, size: bigint>>, fetched_at_unix bigint"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share, ``spark.checkpoint.dir``, or without it, in an application of one
    machine, below its warehouse; on a cluster that setting must not be missing."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}/{name}"


def load(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """A table by its suffix: CSV with a header, JSON lines, else Parquet; ``columns`` prunes the scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    bare = path.removesuffix(".gz")
    if bare.endswith(".csv"):
        df = reader.csv(path, header=True, inferSchema=schema is None)
    elif bare.endswith((".json", ".jsonl")):
        df = reader.json(path)
    else:
        df = reader.parquet(path)
    return df.select(*columns) if columns else df


def split_paths(root: str, dataset: str, config: str, split: str) -> list[str]:
    """Where a split may lie: a directory of Parquet files, then one file."""
    name = dataset.replace("/", "__").replace(":", "__")
    return [f"{root}/{name}/{config}/{split}", f"{root}/{name}/{config}/{split}.parquet"]


def load_split(spark: SparkSession, root: str, dataset: str, config: str, split: str) -> DataFrame:
    for path in split_paths(root, dataset, config, split):
        if exists(spark, path):
            return load(spark, path)
    raise FileNotFoundError(f"no split {dataset}/{config}/{split} below {root}")


def splits_below(spark: SparkSession, root: str, marker: str = "dataset_info.json") -> DataFrame:
    """dataset, config and split of each directory that holds ``marker``, three levels below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", marker).load(root).select("path")
    parts = F.split("path", "/")
    return files.select(*(F.element_at(parts, -k).alias(n) for k, n in ((4, "dataset"), (3, "config"), (2, "split"))))


#: A table gets as many ranges as the session has shuffle partitions times ``RANGES_EACH``, ``MOST_RANGES`` at most; cut
#: points come from ``SAMPLED`` keys a range.  This bounds what the driver holds: strings of 4,095 keys in all.
RANGES_EACH, MOST_RANGES, SAMPLED = 2, 4096, 32


def _key(order: Sequence[str | Column]) -> Column:
    return F.struct(*((F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)))


def with_range(df: DataFrame, order: Sequence[str | Column], out: str = "__range") -> DataFrame:
    """Adds ``__key``, the values of ``order`` as a struct, and ``out``, the number of the range of keys (ascending, nulls
    first) in which the row lies.

    Cut points are drawn once, here, and are constants of the plan: a row's range is a function of its key alone, the same
    in every branch of a plan, on every run and retry.  They only balance the ranges; results must not depend on them.
    A binary search, a projection a step, stays inside generated code.
    """
    ranges = min(RANGES_EACH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    drawn = df.select(_key(order).alias("k"), F.rand(17).alias("r")).orderBy("r").limit(ranges * SAMPLED)
    kind = f"struct<cuts: array<{drawn.schema['k'].dataType.simpleString()}>>"
    taken = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("all", F.floor(i * F.size("all") / F.lit(ranges)).cast("int")))
    cuts = drawn.agg(F.array_sort(F.collect_list("k")).alias("all")).select(F.array_distinct(taken).alias("cuts"))  # one row
    levels = list(reversed(range(ranges.bit_length())))
    # each level of the search looks at cuts of its own, so that the plan holds each cut once
    level_of = lambda k: F.filter("cuts", lambda x, i: i % (2 << k) == (1 << k) - 1)
    own = [F.to_json(F.struct(level_of(k).alias("cuts"))) for k in levels]
    at = F.lit(0)
    rows = df.withColumn("__key", _key(order))
    for k, found in zip(levels, cuts.select(*own).first()):
        cut = F.get(F.from_json(F.lit(found), kind).getField("cuts"), F.shiftright(at, k + 1))
        rows = rows.withColumn(out, F.when(cut <= F.col("__key"), at + F.lit(1 << k)).otherwise(at))
        at = F.col(out)
    return rows


def _before(rows: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """__range and group with the sums of ``values`` over the group's smaller ranges, and over the whole group."""
    sums = rows.groupBy("__range", *groups).agg(*(F.sum(v).alias(v) for v in values))
    group = Window.partitionBy(*groups)  # a row a range in each
    ahead = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    made = [x for v in values for x in (F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"__before{v}"), F.sum(v).over(group).alias(f"__whole{v}"))]
    return sums.select(F.col("__range").alias("__at"), *(F.col(g).alias(f"__of{g}") for g in groups), *made)


def _with_before(rows: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    before = _before(rows, groups, values)
    on = rows["__range"] == before["__at"]
    for g in groups:
        on = on & rows[g].eqNullSafe(before[f"__of{g}"])
    return rows.join(before if groups else F.broadcast(before), on)  # without groups, a row a range


def _ranged(df: DataFrame, within: Sequence[str], order: Sequence[str | Column], values: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    groups = [f"__g{i}" for i in range(len(within))]
    own = [(F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"__o{i}") for i, c in enumerate(order)]
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row")
    rows = df.select(whole, *(F.col(f"`{c}`").alias(g) for c, g in zip(within, groups)), *own, *(v.alias(n) for n, v in values.items()))
    return with_range(rows, [*groups, *(f"__o{i}" for i in range(len(order)))]), groups


def _own(df: DataFrame, besides: Sequence[str]) -> list[Column]:
    return [F.col("__row").getField(c).alias(c) for c in df.columns if c not in besides]


def running_sums(df: DataFrame, order: Sequence[str | Column], sums: dict[str, Column], within: Sequence[str] = (), totals: dict[str, str] | None = None) -> DataFrame:
    """Adds sums over the rows of a group up to each by ``order``, whose values are distinct in a group; ``totals`` names
    columns for the whole group's sums.  Ranges of rows are summed in parallel, so a group may be of any size.  ``df`` is
    read three times."""
    rows, groups = _ranged(df, within, order, {f"__v_{n}": c.cast("long") for n, c in sums.items()})
    upto = Window.partitionBy("__range", *groups).orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
    rows = _with_before(rows, groups, [f"__v_{n}" for n in sums])
    made = [(F.sum(f"__v_{n}").over(upto) + F.col(f"__before__v_{n}")).alias(n) for n in sums] + [F.col(f"__whole__v_{n}").alias(out) for n, out in (totals or {}).items()]
    return rows.select(*_own(df, [*sums, *(totals or {}).values()]), *made)


def with_rank(df: DataFrame, within: Sequence[str], order: Sequence[str | Column], out: str, count: str | None = None) -> DataFrame:
    """Adds the place of each row, from 1, among those of its group by ``order`` (ascending, nulls first), and the group's
    size.  Ties go by a hash of the whole row, so equal runs give equal places.  Groups of any size are numbered in
    parallel, by ranges; nulls in ``within`` are a group.  ``df`` is read three times, so stage it if it is costly."""
    hashed = [F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()))]
    rows, groups = _ranged(df, within, [*order, *hashed], {"__one": F.lit(1)})
    place = F.row_number().over(Window.partitionBy("__range", *groups).orderBy("__key"))
    made = [(place + F.col("__before__one")).cast("long").alias(out)] + ([F.col("__whole__one").alias(count)] if count else [])
    return _with_before(rows, groups, ["__one"]).select(*_own(df, [out, count]), *made)


def with_row_index(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Adds row_index, 0, 1, 2, ... by ``order``: ranges in parallel, then each range's offset."""
    return with_rank(df, [], order, "row_index").withColumn("row_index", F.col("row_index") - 1)


def row_at(df: DataFrame, index: int) -> DataFrame:
    return df.where(F.col("row_index") == index)


def first_index(df: DataFrame, key: str) -> DataFrame:
    """The least row_index of each key that isn't null or empty."""
    return df.where(F.col(key) != "").groupBy(F.col(key).alias("key")).agg(F.min("row_index").alias("row_index"))


def subset(df: DataFrame, ids: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The rows whose key is in ``ids``, some columns: a semi-join, which the planner broadcasts or filters by."""
    return df.select(*dict.fromkeys([key, *columns])).join(ids.select(key).distinct(), key, "left_semi").select(*columns)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Valid commit snapshots: JSON documents, gzip or not, one a file, of kind "commit" with all required fields."""
    df = spark.read.schema(TREE).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    needed = ("repo", "commit_sha", "root_tree_sha", "tree")
    valid = F.col("kind") == "commit"
    for c in needed:
        valid = valid & F.col(c).isNotNull()
    return df.where(valid)


def guard(path: str, frozen: Sequence[str] = ()) -> str:
    """``path``, unless it lies in a frozen directory."""
    clean = path.rstrip("/") + "/"
    for f in frozen:
        if clean.startswith(f.rstrip("/") + "/"):
            raise ValueError(f"{path} lies in the frozen directory {f}")
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", frozen: Sequence[str] = ()) -> None:
    df.write.mode(mode).parquet(guard(path, frozen))


def write_json(df: DataFrame, path: str, compressed: bool = False, frozen: Sequence[str] = ()) -> None:
    """JSON lines, committed whole."""
    df.write.option("compression", "gzip" if compressed else "none").json(guard(path, frozen))


def write_csv(df: DataFrame, path: str, columns: Sequence[str], extra: Sequence[str] = (), frozen: Sequence[str] = ()) -> None:
    """Some columns, each once; extra ones that exist too."""
    df.select(*dict.fromkeys([*columns, *(c for c in extra if c in df.columns)])).write.csv(guard(path, frozen), header=True)


def write_manifest(spark: SparkSession, path: str, **entries) -> None:
    """A small JSON document of a run's settings and outputs."""
    spark.createDataFrame([(json.dumps(entries, default=str, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def cached(spark: SparkSession, path: str, ids: DataFrame, key: str, columns: Sequence[str], make, frozen: Sequence[str] = ()) -> DataFrame:
    """A table kept at ``path``: reused if it has the columns and just the ids, else made anew and returned; rows go by
    id, not by position.  A new one is written beside the old, which ``make`` may read, and takes its place when whole;
    the old one is moved aside first and goes last, so that a failure leaves one of them."""
    guard(path, frozen)
    if exists(spark, path):
        df = spark.read.parquet(path)
        same = ids.select(key).exceptAll(df.select(key).distinct()).isEmpty() and df.select(key).distinct().exceptAll(ids.select(key)).isEmpty()
        if set(columns) <= set(df.columns) and same:
            return df.join(ids.select(key), key)
    aside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    make().write.parquet(aside)
    new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (aside, path))
    store = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = store.exists(old)
    if had and not store.rename(old, before):
        raise OSError(f"{path} could not be moved aside")
    if not store.rename(new, old):
        if had:
            store.rename(before, old)
        raise OSError(f"{aside} could not take the place of {path}")
    if had:
        store.delete(before, True)
    return spark.read.parquet(path)
