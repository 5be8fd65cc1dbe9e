"""Operators over hand-written rows, with the rows that are expected."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from gristmill.functions import ids
from gristmill.functions.repos import repos_in_json
from gristmill.operators import behaviour, matching, patch, tree
from gristmill.plans.registry import Tables, rounded

from .test_queries import canonical

CASES = []


def query(sql):
    return lambda f: CASES.append((f, sql)) or f


DIFF = """diff --git a/src/app.py b/src/app.py
--- a/src/app.py
+++ b/src/app.py
@@ -1,3 +1,5 @@ header
 import os
+def run(x):
+    return x
-for i in y:
@@ -20 +22,2 @@
+class Box:
+    pass
diff --git a/src/app.py b/src/app.py
@@ -40,2 +50,2 @@
---gone
+    if x:
diff --git a/tests/test_app.py b/tests/test_app.py
@@ -1 +1 @@
-async def old():
-    raise ValueError
diff --git a/old.txt b/new.txt
@@ -1 +1 @@
+moved
"""


TREE = [("README", "blob", 10), ("docs/a.md", "blob", None), ("docs", "tree", None), ("src", "tree", None), ("src/app.py", "blob", 30), ("src/lib/app.py", "blob", 20), ("tests/test_app.py", "blob", 40)]


RUNS = [("a__b_12ab34cd_pr_7_run3", "x/aiohttp_final:sha"), ("Org__Repo-9_incomplete_20240101_010101_run12", "sweb.eval.x86_64.org_1776_repo-9"), (" plain ", "img"), (None, None), ("o__r_12ab34cd__fix_run1", "")]


MESSAGES = json.dumps([
    {"role": "system", "content": "s"}, {"role": "user", "content": " first "}, {"role": "user", "content": "x <issue_description> the\nbug </issue_description> y"},
    {"role": "assistant", "content": [{"text": "open src/app.py"}, {"text": "and"}, {"n": 1}], "name": "open_file"}, {"role": "tool", "content": "pytest: 1 failed in src/lib/app.py", "tool_name": "Edit"},
    {"role": "tool", "content": "pytest ok, see src/app.py", "name": "x"},
])


@query("""SELECT * FROM (VALUES ('a__b_12ab34cd_pr_7_run3', 'a__b_12ab34cd_pr_7', 'a__b.12ab34cd.pr_7', 'a_b_12ab34cd_pr_7', NULL, 'aiohttp', NULL),
 ('Org__Repo-9_incomplete_20240101_010101_run12', 'Org__Repo-9_incomplete_20240101_010101', NULL, 'org_repo-9_incomplete_20240101_010101', NULL, 'sweb.eval.x86_64.org_1776_repo-9', 'org__repo-9'),
 (' plain ', 'plain', NULL, ' plain ', NULL, 'img', NULL), (NULL, '', NULL, NULL, NULL, NULL, NULL), ('o__r_12ab34cd__fix_run1', 'o__r_12ab34cd__fix', NULL, 'o_r_12ab34cd_fix', 'r.12ab34cd', NULL, NULL))
 AS v(run, task, pull, flat, repo_sha, image_repo, instance)""")
def f1_f11_ids(t):
    rows = t.spark.createDataFrame(RUNS, "run string, image string")
    r, i = F.col("run"), F.col("image")
    return rows.select("run", ids.task_id(r).alias("task"), ids.pull_instance(r).alias("pull"), ids.separator_free(r).alias("flat"), ids.repo_sha_of_run(r).alias("repo_sha"), ids.repo_of_image(i).alias("image_repo"), ids.instance_of_image(i).alias("instance"))


@query("SELECT ['src/app.py', 'src/app.py', 'tests/test_app.py'] AS files")
def f24_patch_files(t):
    return t.spark.createDataFrame([(DIFF,)], "patch string").select(patch.changed_files(F.col("patch")).alias("files"))


@query("""SELECT 1::BIGINT AS patch_id, 3::BIGINT AS patch_num_files_changed, 5::BIGINT AS patch_num_hunks, 6::BIGINT AS patch_lines_added, 3::BIGINT AS patch_lines_deleted,
 2::BIGINT AS ast_num_functions_modified, 1::BIGINT AS ast_num_classes_modified, 7::BIGINT AS ast_syntax_node_change_count, 1::BIGINT AS cfg_conditionals_added, 1::BIGINT AS cfg_conditionals_deleted,
 round(-(6.0 / 8 * log2(6.0 / 8) + 2.0 / 8 * log2(2.0 / 8)), 6) AS patch_entropy_over_files, 'src/app.py' AS patch_primary_file_path, 24.5 AS patch_hunk_gap_mean,
 round(11.0 / 5, 6) AS func_avg_hunk_span_modified, 1::BIGINT AS patch_test_files_changed, round(5.0 / 3, 6) AS patch_edit_fragmentation, 2.5 AS func_avg_changed_lines_per_touched_function""")
def f25_patch_stats(t):
    rows = t.spark.createDataFrame([(1, DIFF)], "patch_id long, patch string")
    names = ["patch_num_files_changed", "patch_num_hunks", "patch_lines_added", "patch_lines_deleted", "ast_num_functions_modified", "ast_num_classes_modified", "ast_syntax_node_change_count", "cfg_conditionals_added", "cfg_conditionals_deleted", "patch_entropy_over_files", "patch_primary_file_path", "patch_hunk_gap_mean", "func_avg_hunk_span_modified", "patch_test_files_changed", "patch_edit_fragmentation", "func_avg_changed_lines_per_touched_function"]
    out = patch.patch_features(rows).select("patch_id", *names)
    return rounded(out, "patch_entropy_over_files", "patch_hunk_gap_mean", "func_avg_hunk_span_modified", "patch_edit_fragmentation", "func_avg_changed_lines_per_touched_function")


TREE_TYPE = "id long, tree array<struct<path: string, type: string, size: bigint>>, truncated boolean, changed_files array<string>, prompt string"


@query("""SELECT 1::BIGINT AS id, 1 AS tree_present, 1 AS tree_truncated, 5 AS repo_file_count, 2 AS repo_dir_count, 2 AS repo_max_depth, 1.0 AS repo_mean_file_depth, 3 AS repo_python_file_count,
 1 AS repo_test_file_count, 0.2 AS repo_test_ratio, 100::BIGINT AS repo_total_known_size, 25.0 AS repo_mean_known_file_size, 4 AS repo_top_level_dir_count, 1 AS repo_has_docs_dir, 1 AS repo_has_tests_dir,
 0 AS repo_has_examples_dir, 1 AS repo_basename_collision_count, 0.5 AS repo_mean_siblings_per_changed_file, 0.5 AS repo_changed_files_exist_in_tree_ratio
 UNION ALL SELECT 2, 0, 0, 0, 0, 0, 0.0, 0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, NULL, NULL""")
def f27_tree_features(t):
    rows = [(1, TREE, True, ["src/app.py", "lost/x.py"], "the app in src"), (2, None, None, None, "")]
    out = tree.tree_features(t.spark.createDataFrame(rows, TREE_TYPE))
    out = rounded(out.drop("tree", "truncated", "changed_files", "prompt"), "repo_mean_file_depth", "repo_test_ratio", "repo_mean_known_file_size", "repo_mean_siblings_per_changed_file", "repo_changed_files_exist_in_tree_ratio")
    ints = [f.name for f in out.schema if f.dataType.simpleString() == "int"]
    return out.withColumns({c: F.col(c).cast("int") for c in ints})


@query("""SELECT 'the' || chr(10) || 'bug' AS issue, 1 AS found, 'first' AS prompt, 6 AS n, 'open src/app.py' || chr(10) || 'and' AS chunks, 'open_file' AS tool
 UNION ALL SELECT '', 0, 'not json', 0, NULL, NULL UNION ALL SELECT '', 0, '', 0, NULL, NULL""")
def f18_f21_messages(t):
    rows = t.spark.createDataFrame([(MESSAGES,), ("not json",), ("{}",)], "m string").withColumn("p", behaviour.messages(F.col("m")))
    p, none = F.col("p"), F.lit(None).cast("string")
    return rows.select(behaviour.issue_text(p).alias("issue"), behaviour.issue_block_found(p).alias("found"), behaviour.prompt_text(none, none, F.col("m")).alias("prompt"), F.size(p).alias("n"), F.try_element_at(p, F.lit(4))["text"].alias("chunks"), F.try_element_at(p, F.lit(4))["name"].alias("tool"))


@query("""SELECT * FROM (VALUES ('a', ['a/b', 'c/d', 'e/f', 'e/f.git']), ('b', ['o/r', 'x/y.py']), ('c', []), ('d', [])) AS v(id, repos)""")
def f14_f15_repos(t):
    inner = json.dumps({"text": "see https://github.com/c/d/issues/1 and git@github.com:e/f.git", "n": 1})
    rows = [("a", json.dumps({"repo": "a/b", "ds": inner})), ("b", json.dumps([{"instance_id": "o__r.0123abc", "file": "x/y.py", "k": {"id": "me/sweb.eval.x86_64.q", "url": "https://github.com/me/sweb.eval.x86_64.q"}}])), ("c", "{"), ("d", None)]
    return t.spark.createDataFrame(rows, "id string, doc string").select("id", repos_in_json("doc").alias("repos"))


SHA = "0123456789abcdef0123456789abcdef01234567"


def base(t):
    rows = [("Org__Repo.12ab34cd.pr_7", 0), ("org__repo.12ab34cd.pr_7", 1), ("org__repo.12ab34cd.fix_a", 2), ("x__y.99aa88bb.z", 3)]
    return t.spark.createDataFrame(rows, "instance_id string, row_index long")


@query("""SELECT * FROM (VALUES ('org__repo.12ab34cd.pr_7_run1', 1::BIGINT, 0), ('Org__Repo_12ab34cd_pr_7_run2', 1, 1), ('ORG__repo_12ab34cd_fix_a', 2, 2), ('q__repo_12ab34cd__other_run3', 0, 3))
 AS v(trajectory_id, row_index, step)""")
def j12_mirror_cascade(t):
    runs = [("org__repo.12ab34cd.pr_7_run1",), ("Org__Repo_12ab34cd_pr_7_run2",), ("ORG__repo_12ab34cd_fix_a",), ("q__repo_12ab34cd__other_run3",), ("none",), (None,)]
    return matching.resolve_mirrors(t.spark.createDataFrame(runs, "trajectory_id string"), base(t))


@query(f"SELECT * FROM (VALUES ('aio_{SHA}_run1', 0::BIGINT, 0), ('owner_cov_final_{SHA}_run2', 2, 1)) AS v(trajectory_id, row_index, step)")
def j11_commit_cascade(t):
    rows = [(SHA.upper(), "AIO", 0), (SHA, "aio", 1), (SHA, "cov", 2)]
    table = t.spark.createDataFrame(rows, "commit_hash string, repo_name string, row_index long")
    runs = [(f"aio_{SHA}_run1", "me/aio_final:x"), (f"owner_cov_final_{SHA}_run2", "me/else:x"), ("no_commit", "me/aio:x"), (None, "me/aio:x")]
    return matching.resolve_commits(t.spark.createDataFrame(runs, "trajectory_id string, image string"), table, ["owner"])


@query("""SELECT * FROM (VALUES ('a__b-1_run1', 0, 0::BIGINT, 0), ('zz', 0, 1, 1), ('long-owner__with-a-long-name-of-repository-1234567x', 0, 2, 2), ('c__d-5', 1, 0, 0)) AS v(trajectory_id, source, row_index, step)""")
def j13_j14_instance_cascade(t):
    kind = "instance_id string, row_index long"
    one = t.spark.createDataFrame([("a__b-1", 0), ("Own__Rep-2", 1), ("long-owner__with-a-long-name-of-repository-1234567", 2), ("c__d-6", 3)], kind)
    two = t.spark.createDataFrame([("c__d-5", 0)], kind)
    runs = [("a__b-1_run1", ""), ("zz", "sweb.eval.x86_64.own_1776_rep-2"), ("long-owner__with-a-long-name-of-repository-1234567x", None), ("c__d-5", None), ("none", None)]
    return matching.resolve_instances(t.spark.createDataFrame(runs, "trajectory_id string, image string"), one, two)


@query("SELECT * FROM (VALUES ('o/r', 'ABCDEF1', 'o__r__abcdef1.json.gz'), ('o/r', 'abcdef123', 'o__r__abcdef1.json.gz')) AS v(repo, commit, file)")
def j19_sha_prefix(t):
    trees = [("o/r", "abcdef12345", "o__r__abcdef12345.json.gz"), ("o/r", "abcdef1", "o__r__abcdef1.json.gz"), ("o/q", "abcdef1", "x.json.gz")]
    wanted = [("o/r", "ABCDEF1"), ("o/r", "abcdef123"), ("o/r", "abc"), ("o/r", ""), ("o/s", "abcdef1")]
    return matching.find_trees(t.spark.createDataFrame(wanted, "repo string, commit string"), t.spark.createDataFrame(trees, "repo string, commit_sha string, file string"))


@pytest.mark.parametrize("f, sql", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_hand_rows(f, sql, spark, sf):
    got, want = f(Tables(spark, sf)).toPandas(), duckdb.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)
