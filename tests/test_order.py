"""Numbering, running sums, curves and quantiles over tables of many ranges, written out and compared with single-task windows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.operators import metrics, quantiles, ranking, relational, rollup, split
from gristmill.sources import tables

N, PART = 1_000_000, 150_000


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Distinct keys in no order, a group that holds a third of the rows, a value that half of them share."""
    path = str(tmp_path_factory.mktemp("rows") / "t")
    key = F.pmod(F.col("id") * 7_654_321, F.lit(N))
    group = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 101 != 0, F.concat(F.lit("g"), F.pmod(F.xxhash64("id"), F.lit(40))))
    value = F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0, F.lit(0.25)).otherwise(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9_973)) / F.lit(7.0))
    spark.range(N, numPartitions=9).select(key.alias("k"), group.alias("g"), value.alias("v"), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4)) == 0).cast("int").alias("y")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def part(spark, shuffled, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("part") / "t")
    shuffled.where(F.col("k") < PART).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_row_index_is_the_place_of_every_row(spark, shuffled, tmp_path, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        for run in range(2):
            tables.with_row_index(shuffled, ["k"]).write.parquet(f"{tmp_path}/{run}")
            got = spark.read.parquet(f"{tmp_path}/{run}")
            assert got.count() == N and got.where("k <> row_index").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rank_in_groups_equals_a_window(spark, shuffled, tmp_path):
    tables.with_rank(shuffled, ["g"], ["v", "k"], "r", "n").write.parquet(f"{tmp_path}/t")
    group = Window.partitionBy("g")
    want = shuffled.withColumns({"r": F.row_number().over(group.orderBy("v", "k")).cast("long"), "n": F.count(F.lit(1)).over(group)})
    got = spark.read.parquet(f"{tmp_path}/t")
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_ties_are_numbered_alike_in_each_run(spark, part):
    runs = [tables.with_rank(part.repartition(5 + i), ["g"], ["y"], "r").agg(F.sum(F.xxhash64("k", "r").cast("decimal(38,0)"))).first()[0] for i in range(2)]
    assert runs[0] == runs[1]


def test_shards_hold_each_row_once(part):
    seen = [relational.shard(part, ["v", "k"], i, 4).select("k").distinct().count() for i in range(4)]
    assert seen == [PART // 4] * 4


def test_bands_have_tails_of_one_size(part):
    got = {r[0]: r[1] for r in ranking.bands(part, "v", "k").groupBy("difficulty_band").count().collect()}
    assert got["easy"] == got["hard"] == PART // 10


def test_curves_equal_numpy(part):
    rows = part.select("y", F.col("v").alias("p"), "g").toPandas()

    def auc(t):
        rank = t.p.rank(method="average")
        pos, neg = (t.y == 1).sum(), (t.y == 0).sum()
        return (rank[t.y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)

    def precision(t):
        c = t.groupby("p").y.agg(["sum", "count"]).sort_index(ascending=False)
        tp, every = c["sum"].cumsum(), c["count"].cumsum()
        return (c["sum"] / c["sum"].sum() * tp / every).sum()

    df = part.select("y", F.col("v").alias("p"), "g")
    for _ in range(2):
        assert metrics.roc_auc(df).first()[0] == pytest.approx(auc(rows), abs=1e-12)
    got = {r.g: r for r in metrics.ranking_scores(df, keys=["g"]).collect()}
    assert len(got) == 42
    for g, r in got.items():
        t = rows[rows.g.isna()] if g is None else rows[rows.g == g]
        assert r.roc_auc == pytest.approx(auc(t), abs=1e-12) and r.average_precision == pytest.approx(precision(t), abs=1e-12)
    perfect = part.select((F.col("k") >= PART // 2).cast("int").alias("y"), (F.col("k") / F.lit(float(PART))).alias("p"))
    assert metrics.roc_auc(perfect).first()[0] == 1.0
    best = metrics.youden(perfect).first()
    assert best.j == 1.0 and best.threshold == 0.5
    points = metrics.roc_points(perfect).agg(F.max("tpr"), F.max("fpr"), F.count(F.lit(1))).first()
    assert tuple(points) == (1.0, 1.0, PART)


def test_quantiles_equal_numpy(part):
    rows = part.select("g", "v", "k").toPandas()
    at = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    found = quantiles.quantiles(part, {"v": F.col("v"), "k": F.col("k")}, at, ["g"])
    for r in found.collect():
        t = rows[rows.g.isna()] if r.g is None else rows[rows.g == r.g]
        assert r.n == len(t) and np.allclose(r.q, np.quantile(t[r.column], at), rtol=1e-12)
    plan = rollup.describe(part, "v", ["g"])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile(" not in plan and "median(" not in plan


def test_quantiles_of_odd_values(spark):
    rows = [(None, 1.0), (None, None), ("a", float("nan")), ("a", float("inf")), ("a", -1.0), ("b", None), ("c", 2.0), ("c", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.q) for r in quantiles.quantiles(df, {"v": quantiles.finite(F.col("v"))}, [0.5], ["g"]).collect()}
    assert got == {None: (1, [1.0]), "a": (1, [-1.0]), "c": (2, [2.5])}
    assert quantiles.quantiles(df.limit(0), {"v": F.col("v")}, [0.5]).count() == 0


def test_ranks_of_odd_rows(spark):
    rows = [(None, None), (None, None), ("a", float("nan")), ("a", 1.0), ("a", None), ("é", 1.0)]
    df = spark.createDataFrame(rows, "g string, `__row` double")
    got = sorted((str(r.g), str(r["__row"]), r.r, r.n) for r in tables.with_rank(df, ["g"], ["__row"], "r", "n").collect())
    assert got == [("None", "None", 1, 2), ("None", "None", 2, 2), ("a", "1.0", 2, 3), ("a", "None", 1, 3), ("a", "nan", 3, 3), ("é", "1.0", 1, 1)]
    assert tables.with_row_index(df.limit(0), ["g"]).count() == 0


def test_average_rank_equals_pandas(part):
    hot = part.where("g = 'hot'").select("k", "v")
    want = hot.toPandas().set_index("k").v.rank(ascending=False)
    got = ranking.average_rank(hot, "v", "r").toPandas().set_index("k").r
    assert np.allclose(got.sort_index(), want.sort_index())


def test_split_shares_hold_in_each_class(part):
    got = split.train_test(part, "k", "y").groupBy("y", "split").count().collect()
    n = {(r.y, r.split): r["count"] for r in got}
    for y in (0, 1):
        assert n[y, "test"] == -(-(n[y, "test"] + n[y, "train"]) // 5)
