"""Shared pieces: staged tables in the cluster's shared folder, clash-free columns, wide numbering.

Staged tables are Parquet files below ``spark.checkpoint.dir``; they cut lineage and survive the loss of
an executor.  They stay until ``release(spark)`` or the owner of that folder removes them, because a lazy
result may still read them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Prefix of every internal column.
P = "__gm_"


#: What empties the caches that operators keep in a Python worker.
CACHES: dict[str, Callable[[], None]] = {}


def keep_caches_of(name: str) -> None:
    """Workers live on from stage to stage: called at a task's start, this empties the caches of other operators."""
    for other, empty in CACHES.items():
        if other != name:
            empty()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as a full URI: ``spark.checkpoint.dir``.  Without that setting only an application
    with one machine can stage tables, in its warehouse; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def tasks_for(df: DataFrame) -> int:
    """How many tasks ``df`` makes at the session's bytes a task, by the planner's estimate of its size; joins make
    that estimate worthless, so it counts up to a petabyte only."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    each = df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes"))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // each)) if size < 1 << 50 else usual


#: Names of what the running ``staging`` block has staged; each thread has blocks of its own.
_OWN: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging() -> Iterator[list[str]]:
    """Collects the names of all tables that are staged inside, by this thread, for ``drop_staged``."""
    names: list[str] = []
    outer = _OWN.set(names)
    try:
        yield names
    finally:
        _OWN.reset(outer)


def new_path(spark: SparkSession, name: str) -> str:
    made = f"{name}-{uuid.uuid4().hex}"
    if (own := _OWN.get()) is not None:
        own.append(made)
    return f"{shared_dir(spark)}/gristmill/{spark.sparkContext.applicationId}/{made}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, names: Iterable[str]) -> None:
    """Remove staged tables by name, and no other; what reads them becomes invalid."""
    store, top = _store(spark)
    for name in names:
        store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top, name), True)


def staged_now(spark: SparkSession) -> set[str]:
    """Names of the tables that this application has staged and not removed."""
    store, top = _store(spark)
    return {f.getPath().getName() for f in store.listStatus(top)} if store.exists(top) else set()


def _store(spark: SparkSession):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gristmill/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def release(spark: SparkSession) -> None:
    """Remove all tables this application has staged; results that still read them become invalid."""
    store, top = _store(spark)
    store.delete(top, True)


def with_outputs(df: DataFrame, row: str, outputs: dict[str, Column]) -> DataFrame:
    """The fields of struct ``row`` and then ``outputs``; an output replaces a field of its name."""
    names = {k.lower() for k in outputs}
    fields = [f.name for f in df.schema[row].dataType.fields]
    keep = [F.col(row).getField(f).alias(f) for f in fields if f.lower() not in names]
    return df.select(*keep, *(c.alias(k) for k, c in outputs.items()))


def as_row(df: DataFrame, name: str = P + "row") -> Column:
    """All columns as one struct, so that internal names can't clash with any of them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, rows_per_bucket: int = 2_000, deal: str | None = None) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each group, however large, without one task holding a group.

    Rows are dealt to buckets of about ``rows_per_bucket`` rows, by a hash of ``order`` or by the fixed long column
    ``deal``, which can spread equal rows; a bucket's offset is the number of
    its group's rows in smaller buckets.  The order is by bucket, then ``order``.  ``df`` is read three
    times, so stage it if it is costly.  Nulls in ``group`` make a group of their own.
    """
    b, n, before = P + "bucket", P + "n", P + "before"
    buckets = max(1, -(-df.count() // rows_per_bucket))
    dealt = df.withColumn(b, F.pmod(F.col(deal) if deal else F.xxhash64(F.lit(91), *order), F.lit(buckets)))
    sums = dealt.groupBy(*group, b).agg(F.count(F.lit(1)).alias(n))
    sums = sums.withColumn(before, F.sum(n).over(Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.select(*(F.col(c).alias(P + "k_" + c) for c in group), F.col(b).alias(P + "k_b"), F.coalesce(before, F.lit(0)).alias(before))
    ranked = dealt.withColumn(n, F.row_number().over(Window.partitionBy(*group, b).orderBy(*order)) - 1)
    same = [ranked[c].eqNullSafe(sums[P + "k_" + c]) for c in group] + [ranked[b] == sums[P + "k_b"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return ranked.join(sums, on).select(*df.columns, (F.col(before) + F.col(n)).cast("long").alias(out))
