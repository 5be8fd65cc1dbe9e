import os
import difflib
import gzip
import itertools
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import ids, paths, text
from gristmill.operators import metrics, models, nlp, patch, ranking, relational, rollup, shap, split, vif
from gristmill.sources import tables


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


ODD = ["", " ", "a", "a\n", "a\nb", "\r\n", "a\x1cb\x85c d", " 　é\t", "nan", "\x1f x \x1c"]


@pytest.mark.parametrize("s", ODD)
def test_python_strings(spark, s):
    assert one(spark, text.py_strip, s) == s.strip()
    assert one(spark, text.py_lines, s) == s.splitlines()


@pytest.mark.parametrize("s", ["p/test_x.py", "tests/x.py", "a/tests/x.py", "A.TAR.GZ", ".bashrc", "a\\b.c", "plain", "d/.e/f"])
def test_paths(spark, s):
    from pathlib import PurePosixPath

    p = s.replace("\\", "/")
    assert one(spark, paths.extension, s) == PurePosixPath(p).suffix.lower().lstrip(".")
    assert one(spark, paths.parent, s) == (str(PurePosixPath(p).parent) if "/" in p else ".")
    assert one(spark, paths.is_test, s) == (p.rsplit("/", 1)[-1].startswith("test_") or "/tests/" in p)


@pytest.mark.parametrize("a, b, same", [("abcdef1", "ABCDEF1", True), ("abcdef12", "abcdef1", True), ("abcdef", "abcdef1", False), ("abc", "abc", True), ("", "", False), (None, "abcdef1", False)])
def test_sha(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(ids.sha_compatible(F.col("a"), F.col("b"))).first()[0] is same


@pytest.mark.parametrize("repo, commit, want", [("o/r", " ABC1234 ", ("o/r", "abc1234")), ("o__r.abc1234", None, ("o/r", "abc1234")), ("o__r.abc1234", "FFFF", ("o/r", "ffff")), (None, None, ("", "")), ("weird", "", ("weird", ""))])
def test_repo_commit(spark, repo, commit, want):
    df = spark.createDataFrame([(repo, commit)], "a string, b string")
    assert tuple(df.select(ids.repo_commit(F.col("a"), F.col("b")).alias("p")).first().p) == want


def test_task_outcomes_of_odd_rewards(spark):
    runs = spark.createDataFrame([("a", 1.0), ("a", None), ("b", float("nan")), ("c", 1.5), (None, 1.0)], "task_id string, reward double")
    got = {r.task_id: (r.pass_rate, r.n_runs, r.n_success, r.any_success, r.maj_success) for r in rollup.task_outcomes(runs).collect()}
    assert got == {"a": (0.5, 2, 1, 1, 1), "b": (0.0, 1, 0, 0, 0), "c": (1.0, 1, 1, 1, 1)}


def test_task_level(spark):
    runs = [("t1_run1", "t1", "s", 0, 1.0), ("t1_run2", "t1", "s", 1, 0.0), ("t2_run1", "t2", "s", 2, 0.0), ("t3_run1", "t3", "x", 3, 1.0)]
    prompt = spark.createDataFrame([(*r, float(i)) for i, r in enumerate(runs)], "trajectory_id string, task_id string, cf_split string, cf_row_index long, reward double, prompt_a double")
    repo = spark.createDataFrame([(r[0], None if i == 2 else 5.0 + i, 1.0) for i, r in enumerate(runs)], "trajectory_id string, repo_b double, repo_same double")
    patches = spark.createDataFrame([(r[0], "1", 2.0 * i) for i, r in enumerate(runs)], "trajectory_id string, patch_present string, patch_c double")
    mapping = spark.createDataFrame([(r[0], None if i == 0 else "o/r") for i, r in enumerate(runs)] + [("t1_run1", "late")], "trajectory_id string, base_repo string")
    out = rollup.task_level(prompt, repo, patches, mapping, F.col("cf_row_index"), exclude=["x"])
    rows = {r.task_id: r for r in out.collect()}
    assert rows.keys() == {"t1", "t2"} and "repo_same" not in out.columns and out.columns[0] == "task_id"
    assert (rows["t1"].pass_rate, rows["t1"].prompt_a, rows["t1"].repo_b) == (0.5, 0.0, 5.0) and rows["t2"].repo_b == 5.0


def test_lookup_fails_without_a_match(spark):
    df, table = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no v for 2"):
        relational.lookup(df, table, "k", "v").collect()


def test_shards_cover_all_rows(spark):
    df = spark.range(23)
    parts = [sorted(r.id for r in relational.shard(df, ["id"], i, 5).collect()) for i in range(5)]
    assert [x for p in parts for x in p] == list(range(23)) and max(map(len, parts)) == 5
    with pytest.raises(ValueError):
        relational.shard(df, ["id"], 5, 5)


def test_group_folds_do_not_leak(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 13)
    for parts in (split.group_folds(df, "g", 4).select("g", F.col("fold").alias("p")), split.group_split(df, "g").select("g", F.col("split").alias("p"))):
        assert parts.distinct().groupBy("g").count().where("count > 1").isEmpty()
    assert [split.inner_folds(4, groups=3), split.inner_folds(4, smallest_class=1), split.inner_folds(4, rows=100)] == [2, 2, 4]


def test_metrics_of_one_class_and_ties(spark):
    rows = [(1, 0.5), (0, 0.5), (1, 0.5), (1, 0.9), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, p double")
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for (ya, a), (yb, b) in itertools.product(rows, rows) if ya == 1 and yb == 0]
    assert abs(metrics.roc_auc(df).first()[0] - sum(pairs) / len(pairs)) < 1e-12
    assert metrics.roc_auc(df.where("y = 1")).first()[0] is None
    assert tuple(metrics.confusion(df.where("y = 0"), 2.0).first())[:4] == (0, 0, 0, 2)
    assert metrics.youden(df).first().threshold == 0.5 and metrics.youden(df, legacy_offset=True).first().threshold == 0.9


def test_bands_of_few_rows_and_ties(spark):
    df = lambda xs: spark.createDataFrame(list(enumerate(xs)), "pos long, s double")
    assert {r.difficulty_band for r in ranking.bands(df([0.1, 0.5, 0.9, 0.5]), "s", "pos").collect()} <= {"mid_band", "other"}
    tied = {r.pos: r.difficulty_band for r in ranking.bands(df([0.5] * 20), "s", "pos").collect()}
    assert [k for k, v in tied.items() if v == "hard"] == [0, 1] and [k for k, v in tied.items() if v == "easy"] == [18, 19]


def test_vif_of_collinear_columns(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 300))
    df = spark.createDataFrame([(float(x), float(y), float(x + y), float(x + 0.01 * k), 1.0) for x, y, k in zip(a, b, rng.normal(size=300))], "a double, b double, s double, near double, c double")
    kept, gone = vif.select(df, ["a", "b", "s", "near", "c"])
    assert gone[0][0] == "a" and math.isinf(gone[0][1]) and len(kept) == 3 and "c" in kept
    assert max(vif.factors(vif.correlations(df, kept))) <= 10


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2)) * [2, 5] + [1, -3]
    y = x @ [0.02, -0.01] + 0.5 + 0.01 * rng.normal(size=80)
    df = spark.createDataFrame([(float(p), float(q), float(r)) for (p, q), r in zip(x, y)], "a double, b double, y double")
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 3.0 * np.eye(2), z.T @ (y - y.mean()))
    got = [r.p for r in models.ridge(df, ["a", "b"], "y", alpha=3.0).predict(df).collect()]
    assert np.allclose(got, np.clip(z @ w + y.mean(), 0, 1), atol=1e-6)


def brute_shapley(model, x, k):
    """Over all coalitions: a leaf's value weighted by what it lets through."""
    def worth(known):
        total = 0.0
        for v, tests in model:
            p = 1.0
            for f, low, high, z in tests:
                p *= float(low < x[f] <= high) if f in known else z
            total += v * p
        return total

    phi = np.zeros(k)
    for j in range(k):
        rest = [i for i in range(k) if i != j]
        for n in range(k):
            for s in itertools.combinations(rest, n):
                phi[j] += math.factorial(n) * math.factorial(k - n - 1) / math.factorial(k) * (worth({*s, j}) - worth(set(s)))
    return phi


@pytest.mark.parametrize("fit", [models.boosted, models.forest])
def test_attributions_against_all_coalitions(spark, fit, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=3)), 0.0) for i in range(120)]
    df = spark.createDataFrame([(*r[:4], float(r[1] * r[2] > 0)) for r in rows], "id long, a double, b double, c double, y double")
    model = fit(df, ["a", "b", "c"], "y", kind="regression", maxDepth=3, **({"maxIter": 4} if fit is models.boosted else {"numTrees": 4}))
    leaves = shap.leaves(spark, model)
    x = np.array([r[1:4] for r in rows[:6]])
    phi = shap.values(leaves, x)
    assert np.allclose(phi, [brute_shapley(leaves, v, 3) for v in x])
    both = shap.interactions(leaves, x)
    assert np.allclose(both.sum(2), phi) and np.allclose(both, both.transpose(0, 2, 1))
    model.save("file://" + str(tmp_path / "m"))
    again = models.Fitted.load("file://" + str(tmp_path / "m"))
    assert again.features == model.features and again.predict(df).exceptAll(model.predict(df)).isEmpty()
    out, expected = shap.attributions(model, df, "id")
    clipped = again.predict(df)
    total = out.withColumn("s", F.lit(expected) + F.aggregate("phi", F.lit(0.0), lambda s, v: s + v)).join(clipped, "id")
    assert total.where("abs(greatest(0, least(1, s)) - p) > 1e-6").isEmpty()


def test_tree_documents(spark, tmp_path):
    doc = {"repo": "o/r", "kind": "commit", "commit_sha": "a" * 40, "root_tree_sha": "b", "truncated": False, "tree": [{"path": "x.py", "type": "blob", "size": 3}]}
    for name, d in (("a", doc), ("b", doc | {"kind": "branch"}), ("c", {k: v for k, v in doc.items() if k != "tree"})):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            json.dump(d, f)
    (tmp_path / "bad.json").write_text("{")
    got = tables.read_trees(spark, "file://" + str(tmp_path)).collect()
    assert len(got) == 1 and got[0].tree[0].path == "x.py"


def test_sinks(spark, tmp_path):
    df, root = spark.createDataFrame([(2, "x"), (1, "y")], "id long, v string"), "file://" + str(tmp_path)
    tables.write_json(df, root + "/j.json", compressed=True)
    tables.write_csv(df, root + "/c.csv", ["id", "v", "id"], extra=["none"])
    assert sorted(map(tuple, tables.load(spark, root + "/c.csv").collect())) == sorted(map(tuple, tables.load(spark, root + "/j.json").select("id", "v").collect())) == [(1, "y"), (2, "x")]
    assert tables.load(spark, root + "/c.csv", schema="id long, v string").count() == 2
    with pytest.raises(ValueError):
        tables.write_parquet(df, root + "/frozen/a", frozen=[root + "/frozen"])
    made = []
    make = lambda: made.append(1) or df
    for _ in range(2):
        assert tables.cached(spark, root + "/cache", df, "id", ["v"], make).count() == 2
    assert len(made) == 1
    tables.write_manifest(spark, root + "/m", seed=1)
    assert json.loads(spark.read.text(root + "/m").first()[0]) == {"seed": 1}
    tables.write_parquet(df, root + "/sets/n/c/train")
    assert tables.load_split(spark, root + "/sets", "n", "c", "train").count() == 2
    with pytest.raises(FileNotFoundError):
        tables.load_split(spark, root + "/sets", "n", "c", "test")


def test_row_index(spark):
    df = tables.with_row_index(spark.range(100).select((99 - F.col("id")).alias("k")).repartition(7), ["k"])
    assert all(r.k == r.row_index for r in df.collect())


@pytest.mark.parametrize("p", [None, "", "nan", "diff --git a/x b/y\n+a", 'diff --git "a/q" "b/q"', "+++\n---\n@@ broken"])
def test_odd_patches(spark, p):
    row = patch.patch_features(spark.createDataFrame([(1, p)], "patch_id long, patch string")).first()
    assert row.patch_num_files_changed == 0 and row.patch_present == int(p not in (None, "", "nan")) and row.patch_primary_file_path == ""
    assert row.patch_lines_added == (1 if p and "+a" in p else 0) and len(row) == 32


def test_fuzzy_ratio_is_the_library_s(spark):
    from gristmill.operators.matching import similarity_ratio

    pairs = [("abcd", "bcde"), ("", ""), ("Straße", "STRASSE"), ("x" * 300, "x" * 299 + "y")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(similarity_ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(a=a.casefold(), b=b.casefold()).ratio() for a, b in pairs]


def test_parse_of_nothing(spark):
    for kind in ("prompt", "parse"):
        assert len(nlp.metric_names(kind)) == {"prompt": 26, "parse": 53}[kind]
        assert set(nlp.METRICS[kind](nlp.Parse(nlp._BLANK)).values()) == {0.0}
    assert re.fullmatch("prompt_parse_.*", nlp.metric_names("parse")[0])


def test_entry_works_without_the_corpus_operators(spark, sf, tmp_path):
    import shutil
    import subprocess
    import sys

    from tests.conftest import ROOT

    for name in ("__spark_entry__.py", "corpus_pipeline.py", "gristmill"):
        if not os.path.exists(f"{ROOT}/{name}"):
            continue
        source = f"{ROOT}/{name}"
        (shutil.copy if name.endswith(".py") else shutil.copytree)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "gristmill" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') for k in q), q.keys(); assert set(e.oracle_sql()) <= set(q)"
    # with the pipeline's file there, and gone too
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_lemma_sets_keep_what_is_no_letter(spark):
    from gristmill.operators import nlp

    rows = [("d", k, i, lemma, stop) for k, sent in enumerate((("fix", "v2", " "), ("run", "v2", "The"))) for i, lemma in enumerate(sent) for stop in [lemma == "The"]]
    df = spark.createDataFrame(rows, "doc_id string, sent_id int, i int, lemma string, is_stop boolean").selectExpr("*", "false as is_space", "false as is_punct", "lemma rlike '^[a-z]+$' as is_alpha")
    assert abs(nlp.lemma_overlaps(df).first()[1] - 1 / 3) < 1e-9


def test_tokens_of_a_long_sentence_have_numbers_of_their_own(spark):
    from gristmill.operators import nlp

    df = spark.createDataFrame([(1, "a " * 100_005 + ". b c")], "doc_id long, text string")
    out = nlp.plain_tokens(df)
    assert out.select("i").distinct().count() == out.count() == 100_008


def test_synthetic_repositories_in_addresses_are_none(spark):
    from gristmill.functions.repos import names_in
    from pyspark.sql import functions as F

    rows = [("https://github.com/me/sweb.eval.x86_64.q", "url"), ("https://github.com/me/real", "url"), ("me/swesmith.x86_64.q", "repo"), ("img/sweb.eval.x86_64.o_1776_r.0123abcd", "image"), ("o__r.0123abc", "id"), ("o__r.0123abc", "repo"), (None, "text")]
    got = [r[0] for r in spark.createDataFrame(rows, "v string, k string").select(names_in(F.col("v"), F.col("k"))).collect()]
    assert got[:6] == [[], ["me/real"], [], ["o/r"], ["o/r"], []] and not got[6]


def test_cached_table_is_replaced_when_whole(spark, tmp_path):
    from gristmill.sources.tables import cached

    path, ids = f"file://{tmp_path}/kept", spark.range(3).withColumnRenamed("id", "k")
    make = lambda n: spark.range(n).selectExpr("id as k", "id * 2 as v")
    assert cached(spark, path, ids, "k", ["v"], lambda: make(3)).count() == 3
    more = spark.range(5).withColumnRenamed("id", "k")
    assert cached(spark, path, more, "k", ["v"], lambda: spark.read.parquet(path).unionByName(make(5).where("k > 2"))).count() == 5
    import pytest

    with pytest.raises(Exception):
        cached(spark, path, spark.range(9).withColumnRenamed("id", "k"), "k", ["v"], lambda: make(9).selectExpr("k", "raise_error('broken') as v"))
    assert spark.read.parquet(path).count() == 5


def test_plot_names_keep_letters_of_any_script(spark):
    from gristmill.functions.text import plot_name

    df = spark.createDataFrame([("größe / 数 a.b-c_d",), ("x" * 200,), (None,)], "s string")
    assert [r[0] for r in df.select(plot_name(F.col("s"))).collect()] == ["größe_数_a.b-c_d", "x" * 120, None]
