"""Plot data on small rows."""

from pyspark.sql import functions as F

from gristmill.operators import plots


def test_waterfalls_end_at_the_score(spark):
    rows = [("r", f"f{k}", v) for k, v in enumerate([0.5, -0.5, 0.1, 0.2, None])] + [("s", "f0", 1.0)]
    df = spark.createDataFrame(rows, "row string, f string, phi double")
    got = {(r.row, r.place): r for r in plots.waterfall(df, "row", "f", "phi", F.lit(1.0), 3).collect()}
    assert [(got["r", p].feature, got["r", p].features) for p in (1, 2, 3)] == [("f0", 1), ("f1", 1), ("others", 3)]
    assert got["r", 3].start == 1.0 and abs(got["r", 1].end - 1.3) < 1e-12 and abs(got["r", 1].start - got["r", 2].end) < 1e-12
    assert got["s", 1].end == 2.0 and len(got) == 4
    whole = plots.waterfall(df, "row", "f", "phi", F.lit(0.0), 5).where("row = 'r'").collect()
    assert len(whole) == 5 and "others" not in {r.feature for r in whole}


def test_density_counts_every_finite_row(spark):
    rows = [("a", 0.0, 0.0, 1.0), ("a", 1.0, 1.0, 3.0), ("a", 0.99, 1.0, 5.0), ("a", float("nan"), 0.0, 0.0), ("a", None, 1.0, 0.0), (None, 2.0, 7.0, 2.0), (None, 2.0, 7.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, c double")
    got = {tuple(r) for r in plots.density(df, ["g"], "x", "y", 10, "c").collect()}
    assert got == {("a", 0, 0, 1, 1.0), ("a", 9, 9, 2, 4.0), (None, 0, 0, 2, 3.0)}
    assert plots.density(df.limit(0), ["g"], "x", "y").count() == 0


def test_partners(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("c", "a", 1.0), ("c", "b", 3.0), ("d", "d", 9.0)], "x string, y string, s double")
    assert {tuple(r) for r in plots.partners(df, "x", "y", "s").collect()} == {("a", "b", 1.0), ("b", "c", 3.0), ("c", "b", 3.0)}
