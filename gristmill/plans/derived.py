"""Identifiers, messages, patches, trees and cascades over values that the tables' rows are made into; the SQL knows the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions.repos import repos_in_json
from ..operators import behaviour, matching, patch, tree
from .registry import query, rounded


@query("""
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 6 AS form, md5(CAST(o_orderkey AS VARCHAR)) AS h, CAST(o_custkey AS VARCHAR) AS n FROM orders),
s AS (SELECT *, left(h, 8) AS a, h || left(h, 8) AS c FROM r)
SELECT k,
 CASE form WHEN 0 THEN 'a__b_' || a || '_pr_' || n WHEN 1 THEN 'Org__Repo-' || n || '_incomplete_20240101_010101' WHEN 2 THEN 'plain' WHEN 3 THEN '' WHEN 4 THEN 'o__r_' || a || '__fix' ELSE 'me_aiohttp_final_' || c END AS task,
 CASE form WHEN 0 THEN 'a__b_' || a || '_pr_' || n WHEN 1 THEN 'Org__Repo-' || n WHEN 2 THEN ' plain ' WHEN 4 THEN 'o__r_' || a || '__fix' WHEN 5 THEN 'me_aiohttp_final_' || c END AS complete,
 CASE form WHEN 0 THEN 'a_b_' || a || '_pr_' || n WHEN 1 THEN 'org_repo-' || n || '_incomplete_20240101_010101' WHEN 2 THEN ' plain ' WHEN 4 THEN 'o_r_' || a || '_fix' WHEN 5 THEN 'me_aiohttp_final_' || c END AS flat,
 CASE form WHEN 4 THEN 'r.' || a END AS repo_sha, CASE form WHEN 0 THEN 'a__b.' || a || '.pr_' || n END AS pull, CASE form WHEN 0 THEN 'b.' || a END AS pull_sha,
 CASE form WHEN 0 THEN 'aiohttp' WHEN 1 THEN 'sweb.eval.x86_64.org_1776_repo-' || n WHEN 2 THEN 'img' WHEN 5 THEN 'numpy' END AS image_repo, CASE form WHEN 5 THEN 'aiohttp' END AS run_repo,
 CASE WHEN form IN (2, 5) THEN c END AS commit, CASE form WHEN 1 THEN 'org/repo' END AS owner_repo, CASE form WHEN 1 THEN 'org__repo-' || n END AS instance FROM s""")
def f1_f11_ids(t):
    n, run_no = F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 9).cast("string")
    h = F.md5(F.col("o_orderkey").cast("string"))
    a, c, end = F.left(h, F.lit(8)), F.concat(h, F.left(h, F.lit(8))), F.concat(F.lit("_run"), run_no)
    runs = [
        F.concat(F.lit("a__b_"), a, F.lit("_pr_"), n, end), F.concat(F.lit("Org__Repo-"), n, F.lit("_incomplete_20240101_010101"), end), F.lit(" plain "), F.lit(None).cast("string"),
        F.concat(F.lit("o__r_"), a, F.lit("__fix"), end), F.concat(F.lit("me_aiohttp_final_"), c, end),
    ]
    images = [F.lit("x/aiohttp_final:sha"), F.concat(F.lit("sweb.eval.x86_64.org_1776_repo-"), n), F.concat(F.lit("img:"), F.upper(c)), F.lit(None).cast("string"), F.lit(""), F.lit("ns/Numpy_final:sha")]
    form = (F.col("o_orderkey") % 6).cast("int")
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.get(F.array(*runs), form).alias("run"), F.get(F.array(*images), form).alias("image"))
    r, i = F.col("run"), F.col("image")
    pull = ids.pull_instance(r)
    owner = ids.owner_repo(ids.without_incomplete(r))
    return rows.select(
        "k", ids.task_id(r).alias("task"), ids.without_incomplete(r).alias("complete"), ids.separator_free(r).alias("flat"), ids.repo_sha_of_run(r).alias("repo_sha"), pull.alias("pull"),
        ids.repo_sha_of_instance(pull).alias("pull_sha"), ids.repo_of_image(i).alias("image_repo"), ids.repo_of_run(r, ["me"]).alias("run_repo"), ids.commit_of(r, i).alias("commit"),
        F.when(owner.isNotNull(), F.concat_ws("/", owner["owner"], owner["repo"])).alias("owner_repo"), ids.instance_of_image(i).alias("instance"),
    )


@query("""
WITH c AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'x <issue_description> ' || text || ' </issue_description> y' ELSE text END AS said, text, (conv_id + turn) % 3 = 0 AS block, turn % 4 = 3 AS chunks FROM conversations)
SELECT conv_id, count(*) AS n, CAST(coalesce(bool_or(role = 'user' AND block AND NOT chunks), false) AS INTEGER) AS found,
 coalesce(trim(arg_min(text, turn) FILTER (WHERE role = 'user' AND block AND NOT chunks)), trim(arg_min(said, turn) FILTER (WHERE role = 'user' AND NOT chunks)), '') AS issue,
 coalesce(trim(arg_min(CASE WHEN chunks THEN text || chr(10) || 'more' ELSE said END, turn) FILTER (WHERE role = 'user')), '') AS prompt,
 arg_max(CASE WHEN chunks THEN text || chr(10) || 'more' ELSE said END, turn) AS last, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS named FROM c GROUP BY 1""")
def f18_f21_messages(t):
    """Conversations as JSON arrays of messages, some with blocks, some in chunks."""
    block, chunks = (F.col("conv_id") + F.col("turn")) % 3 == 0, F.col("turn") % 4 == 3
    said = F.when(block, F.concat(F.lit("x <issue_description> "), "text", F.lit(" </issue_description> y"))).otherwise(F.col("text"))
    name = F.when(F.col("role") == "assistant", "Open_File")
    plain = F.to_json(F.struct("role", said.alias("content"), name.alias("name")))
    listed = F.to_json(F.struct("role", F.array(F.struct(F.col("text").alias("text")), F.struct(F.lit("more").alias("text"))).alias("content"), name.alias("tool_name")))
    m = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(chunks, listed).otherwise(plain).alias("m")))), lambda x: x["m"]), ","), F.lit("]"))
    rows = t.conversations.groupBy("conv_id").agg(m.alias("m")).withColumn("p", behaviour.messages(F.col("m")))
    p, none = F.col("p"), F.lit(None).cast("string")
    return rows.select(
        "conv_id", F.size(p).cast("long").alias("n"), behaviour.issue_block_found(p).alias("found"), behaviour.issue_text(p).alias("issue"), behaviour.prompt_text(none, none, F.col("m")).alias("prompt"),
        F.try_element_at(p, F.lit(-1))["text"].alias("last"), F.size(F.filter(p, lambda x: x["name"] == "open_file")).cast("long").alias("named"),
    )


FILE_SQL = "CASE WHEN l_suppkey % 5 = 0 THEN 'tests/test_' || (l_partkey % 3) || '.py' ELSE 'src/d' || (l_partkey % 7) || '/f' || (l_suppkey % 5) || '.py' END"
HUNKS_SQL = f"""
WITH h AS (SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, {FILE_SQL} AS file, CAST(l_returnflag = 'R' AS BIGINT) AS r, CAST(l_returnflag = 'A' AS BIGINT) AS a,
  l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS start FROM lineitem)"""


def patches(t):
    """Orders as patches: a file header and a hunk a line."""
    s = lambda c: c.cast("string")
    part, supp, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long")
    src = F.concat(F.lit("src/d"), s(part % 7), F.lit("/f"), s(supp % 5), F.lit(".py"))
    file = F.when(supp % 5 == 0, F.concat(F.lit("tests/test_"), s(part % 3), F.lit(".py"))).otherwise(src)
    at = F.col("l_linenumber") * 10
    head = F.concat(F.lit("diff --git a/"), file, F.lit(" b/"), file, F.lit("\n--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n@@ -"), s(at), F.lit(","), s(q), F.lit(" +"), s(at + q), F.lit(","), s(q + 1), F.lit(" @@ x\n ctx\n"))
    body = F.concat(F.lit("+def g"), s(part % 3), F.lit("(x):\n+    return x\n"), F.when(F.col("l_returnflag") == "R", "-    if old:\n-    pass\n").otherwise(""), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("+class K"), s(supp % 2), F.lit(":\n"))).otherwise(""))
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", q.alias("q"), F.concat(head, body).alias("text"))))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("patch"))


@query(HUNKS_SQL + " SELECT k, string_agg(file, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, q) AS files FROM h GROUP BY 1")
def f24_patch_files(t):
    return patches(t).select("k", F.array_join(patch.changed_files(F.col("patch")), "|").alias("files"))


@query(HUNKS_SQL + """,
g AS (SELECT *, greatest(start - coalesce(lag(start) OVER f, start), 0) AS step, lag(start) OVER f IS NOT NULL AS later FROM h WINDOW f AS (PARTITION BY k, file ORDER BY l_linenumber, l_partkey, l_suppkey, q)),
w AS (SELECT k, count(*) AS n, CAST(sum(r) AS BIGINT) AS nr, CAST(sum(a) AS BIGINT) AS na, count(DISTINCT file || ' ' || (l_partkey % 3)) AS defs, count(DISTINCT CASE WHEN a = 1 THEN file || ' ' || (l_suppkey % 2) END) AS classes,
  avg(q + 1) AS span, coalesce(avg(step) FILTER (WHERE later), 0) AS gap FROM g GROUP BY 1),
f AS (SELECT k, file, sum(2 + 2 * r + a) AS churn FROM h GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY churn) AS i, sum(churn) OVER (PARTITION BY k) AS total, count(*) OVER (PARTITION BY k) AS files FROM f),
e AS (SELECT k, any_value(files) AS files, CASE WHEN any_value(files) > 1 THEN -sum(churn / total * log2(churn / total)) ELSE 0.0 END AS entropy,
  CASE WHEN any_value(files) > 1 THEN 2.0 * sum(i * churn) / (any_value(files) * any_value(total)) - (any_value(files) + 1.0) / any_value(files) ELSE 0.0 END AS gini, arg_min(file, (-churn, file)) AS main,
  count(DISTINCT regexp_replace(file, '/[^/]*$', '')) AS dirs, max(CASE WHEN starts_with(file, 'src') THEN 2 ELSE 1 END) AS deepest, avg(CASE WHEN starts_with(file, 'src') THEN 2 ELSE 1 END) AS depth,
  CAST(sum(CASE WHEN starts_with(file, 'tests') THEN 1 ELSE 0 END) AS BIGINT) AS tests FROM o GROUP BY 1)
SELECT w.k AS patch_id, 1 AS patch_present, n AS patch_num_files_changed, n AS patch_num_hunks, 2 * n + na AS patch_lines_added, 2 * nr AS patch_lines_deleted, 2 * n + na + 2 * nr AS patch_lines_changed_total,
 defs AS ast_num_functions_modified, defs AS func_num_functions_touched, classes AS ast_num_classes_modified, 2 * n + nr + na AS ast_syntax_node_change_count, CAST(defs + classes + 2 * n + nr + na AS DOUBLE) AS ast_edit_distance_proxy,
 CAST(0 AS BIGINT) AS cfg_conditionals_added, nr AS cfg_conditionals_deleted, -nr AS cfg_conditionals_delta, nr AS cfg_conditionals_total_changed, round((2 * n + na + 2 * nr) / defs, 6) AS func_avg_changed_lines_per_touched_function,
 round(span, 6) AS func_avg_hunk_span_modified, round(gap, 6) AS patch_hunk_gap_mean, dirs AS patch_num_unique_dirs_changed, CAST(deepest AS BIGINT) AS patch_max_file_depth, round(depth, 6) AS patch_mean_file_depth,
 CAST(1 AS BIGINT) AS patch_extensions_changed_count, files AS patch_python_files_changed, tests AS patch_test_files_changed, files - tests AS patch_src_files_changed, main AS patch_primary_file_path,
 round(entropy, 6) AS patch_entropy_over_files, round(greatest(0.0, least(1.0, gini)), 6) AS patch_churn_gini_over_files, CASE WHEN starts_with(main, 'src') THEN 2 ELSE 1 END AS patch_primary_file_depth, 1.0 AS patch_edit_fragmentation,
 CAST(n = 1 AS INTEGER) AS patch_is_single_file FROM w JOIN e ON e.k = w.k""")
def f25_patch_stats(t):
    """All 31 features of each order's patch."""
    out = patch.patch_features(patches(t).withColumnRenamed("k", "patch_id")).drop("patch")
    return rounded(out, *(f.name for f in out.schema if f.dataType.simpleString() == "double" and f.name != "ast_edit_distance_proxy"))


@query("""
WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/')[1] AS host, regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '') AS path, length(html) AS size FROM pages),
d AS (SELECT host, trim(path, '/') AS path, size FROM p), b AS (SELECT host, path, string_split(path, '/')[1] AS top, string_split(path, '/')[-1] AS name, length(path) - length(replace(path, '/', '')) AS depth, size FROM d),
n AS (SELECT host, sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS collisions FROM (SELECT host, name, count(*) AS c FROM b GROUP BY 1, 2) GROUP BY 1)
SELECT host AS id, 1 AS tree_present, 1 AS tree_truncated, CAST(count(*) AS INTEGER) AS repo_file_count, CAST(count(*) AS INTEGER) AS repo_dir_count, CAST(max(depth) AS INTEGER) AS repo_max_depth, round(avg(depth), 6) AS repo_mean_file_depth,
 CAST(sum(size) AS BIGINT) AS repo_total_known_size, round(avg(size), 6) AS repo_mean_known_file_size, CAST(count(DISTINCT top) AS INTEGER) AS repo_top_level_dir_count, CAST(any_value(collisions) AS INTEGER) AS repo_basename_collision_count,
 round(0.5, 6) AS repo_changed_files_exist_in_tree_ratio FROM b JOIN n USING (host) GROUP BY 1""")
def f27_tree_features(t):
    """Hosts as trees: their pages' paths as files, first segments as directories."""
    bare = F.regexp_replace("url", "^https?://", "")
    path = F.btrim(F.regexp_replace(F.regexp_replace(bare, "^[^/]*/", ""), "[?#].*$", ""), F.lit("/"))
    entry = lambda p, kind, size: F.struct(p.alias("path"), F.lit(kind).alias("type"), size.alias("size"))
    files = entry(path, "blob", F.length("html").cast("long"))
    folders = entry(F.substring_index(path, "/", 1), "tree", F.lit(None).cast("long"))
    rows = t.pages.groupBy(F.substring_index(bare, "/", 1).alias("id")).agg(F.concat(F.collect_list(files), F.collect_list(folders)).alias("tree"), F.array(F.min(path), F.lit("lost/x.py")).alias("changed_files"))
    out = tree.tree_features(rows.withColumn("truncated", F.lit(True)))
    names = ["tree_present", "tree_truncated", "repo_file_count", "repo_dir_count", "repo_max_depth", "repo_mean_file_depth", "repo_total_known_size", "repo_mean_known_file_size", "repo_top_level_dir_count", "repo_basename_collision_count", "repo_changed_files_exist_in_tree_ratio"]
    out = rounded(out.select("id", *names), "repo_mean_file_depth", "repo_mean_known_file_size", "repo_changed_files_exist_in_tree_ratio")
    return out.withColumns({c: F.col(c).cast("int") for c in ("repo_max_depth",)})


@query("""
WITH p AS (SELECT page_id, 'o' || page_id % 7 AS o, 'r' || page_id % 5 AS r, left(md5(url), 8) AS h FROM pages)
SELECT page_id, array_to_string(list_sort(list_distinct([o || '/' || r, 'c/' || r, 'e/' || o, 'e/' || o || '.git', 'q' || o || '/' || r])), ' ') AS repos FROM p""")
def f14_f15_repos(t):
    """A name as it is, addresses in a text (of one that ends it, with and without .git), JSON in a text, an instance id; paths
    and numbers name nothing."""
    o, r = F.concat(F.lit("o"), (F.col("page_id") % 7).cast("string")), F.concat(F.lit("r"), (F.col("page_id") % 5).cast("string"))
    inner = F.to_json(F.struct(F.concat(F.lit("see https://github.com/c/"), r, F.lit("/issues/1 and git@github.com:e/"), o, F.lit(".git")).alias("text"), F.lit(1).alias("n")))
    instance = F.concat(F.lit("q"), o, F.lit("__"), r, F.lit("."), F.left(F.md5("url"), F.lit(8)))
    doc = F.to_json(F.struct(F.concat_ws("/", o, r).alias("repo"), inner.alias("ds"), F.array(F.struct(instance.alias("instance_id"), F.lit("x/y/z.py").alias("file"))).alias("rows")))
    return t.pages.select("page_id", doc.alias("doc")).select("page_id", F.array_join(repos_in_json("doc"), " ").alias("repos"))


@query("""
WITH t AS (SELECT 'o/' || o_custkey % 40 AS repo, left(md5(CAST(o_orderkey AS VARCHAR)), CAST(7 + o_orderkey % 30 AS INTEGER)) AS sha FROM orders),
w AS (SELECT DISTINCT 'o/' || o_custkey % 40 AS repo, CASE WHEN o_orderkey % 2 = 0 THEN upper(left(md5(CAST(o_orderkey AS VARCHAR)), CAST(5 + o_orderkey % 11 AS INTEGER))) ELSE left(md5(CAST(o_orderkey AS VARCHAR)), CAST(5 + o_orderkey % 11 AS INTEGER)) END AS c FROM orders)
SELECT w.repo, c AS commit, arg_min(sha, (sha <> lower(c), sha)) AS file FROM w JOIN t ON t.repo = w.repo AND (sha = lower(c) OR (length(c) >= 7 AND length(sha) >= 7 AND (starts_with(sha, lower(c)) OR starts_with(lower(c), sha)))) GROUP BY 1, 2""")
def j19_sha_prefix(t):
    """Orders as snapshots of 40 repositories by shortened hashes, asked for by other lengths and in either case."""
    key, repo = F.md5(F.col("o_orderkey").cast("string")), F.concat(F.lit("o/"), (F.col("o_custkey") % 40).cast("string")).alias("repo")
    sha = F.left(key, (7 + F.col("o_orderkey") % 30).cast("int"))
    short = F.left(key, (5 + F.col("o_orderkey") % 11).cast("int"))
    wanted = t.orders.select(repo, F.when(F.col("o_orderkey") % 2 == 0, F.upper(short)).otherwise(short).alias("commit")).distinct()
    return matching.find_trees(wanted, t.orders.select(repo, sha.alias("commit_sha"), sha.alias("file")))


@query("""
WITH b AS (SELECT md5(CAST(o_custkey AS VARCHAR)) || left(md5('x' || o_custkey), 8) AS sha, min(o_orderkey) AS row_index FROM orders GROUP BY 1),
r AS (SELECT o_orderkey AS k, 'lib_final_' || md5(CAST(o_custkey AS VARCHAR)) || left(md5('x' || o_custkey), 8) || '_run' || o_orderkey AS id, md5(CAST(o_custkey AS VARCHAR)) || left(md5('x' || o_custkey), 8) AS sha FROM orders)
SELECT id AS trajectory_id, row_index, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS step FROM r JOIN b ON b.sha = r.sha WHERE k % 5 <> 0""")
def j11_commit_cascade(t):
    """Runs whose image names the repository (step 0), or another one, so that the run's own counts (1); some have no image."""
    cust = F.col("o_custkey").cast("string")
    sha = F.concat(F.md5(cust), F.left(F.md5(F.concat(F.lit("x"), cust)), F.lit(8)))
    base = t.orders.select(F.upper(sha).alias("commit_hash"), F.lit("LIB").alias("repo_name"), F.col("o_orderkey").alias("row_index"))
    image = F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 2 == 0, "me/lib_final:x").otherwise("me/other:x")
    runs = t.orders.select(F.concat(F.lit("lib_final_"), sha, F.lit("_run"), F.col("o_orderkey").cast("string")).alias("trajectory_id"), image.alias("image"))
    return matching.resolve_commits(runs, base)


@query("""
WITH i AS (SELECT c_custkey AS row_index, left(md5(CAST(c_custkey AS VARCHAR)), 8) AS h, c_custkey % 4 AS form FROM customer), f AS (SELECT h, min(row_index) AS first_row FROM i GROUP BY 1)
SELECT CASE form WHEN 0 THEN 'org__lib.' || i.h || '.pr_' || row_index || '_run1' WHEN 1 THEN 'ORG__lib_' || i.h || '_pr_' || row_index || '_run2' WHEN 2 THEN 'Org__LIB_' || i.h || '_fix_' || row_index ELSE 'none__lib_' || i.h || '__other_run3' END AS trajectory_id,
 CASE WHEN form = 3 THEN first_row ELSE row_index END AS row_index, CAST(form AS INTEGER) AS step FROM i JOIN f ON f.h = i.h""")
def j12_mirror_cascade(t):
    """Customers as mirrored instances, each asked for by the step of the cascade that its number names."""
    n = F.col("c_custkey").cast("string")
    h, form = F.left(F.md5(n), F.lit(8)), F.col("c_custkey") % 4
    kind = F.when(form == 2, F.concat(F.lit("fix_"), n)).otherwise(F.concat(F.lit("pr_"), n))
    base = t.customer.select(F.concat(F.lit("org__lib."), h, F.lit("."), kind).alias("instance_id"), F.col("c_custkey").alias("row_index"))
    run = F.when(form == 0, F.concat(F.lit("org__lib."), h, F.lit(".pr_"), n, F.lit("_run1"))).when(form == 1, F.concat(F.lit("ORG__lib_"), h, F.lit("_pr_"), n, F.lit("_run2")))
    run = run.when(form == 2, F.concat(F.lit("Org__LIB_"), h, F.lit("_fix_"), n)).otherwise(F.concat(F.lit("none__lib_"), h, F.lit("__other_run3")))
    return matching.resolve_mirrors(t.customer.select(run.alias("trajectory_id")), base)


@query("""
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS form, repeat('long-name-', 5) || md5(CAST(s_suppkey AS VARCHAR)) AS name FROM supplier)
SELECT CASE form WHEN 0 THEN 'a__' || name || '-' || k || '_run1' WHEN 1 THEN 'run' || k WHEN 2 THEN 'a__' || name || '-' || k || 'x' ELSE 'b__' || name || '-' || k END AS trajectory_id,
 CAST(form = 3 AS INTEGER) AS source, k AS row_index, CASE form WHEN 3 THEN 0 ELSE CAST(form AS INTEGER) END AS step FROM s""")
def j13_j14_instance_cascade(t):
    """Suppliers as instances, found by id, by image, by similarity, or in a second table."""
    k = F.col("s_suppkey").cast("string")
    form, name = F.col("s_suppkey") % 4, F.concat(F.repeat(F.lit("long-name-"), 5), F.md5(k))
    instance = F.concat(F.when(form == 3, "b__").otherwise("a__"), name, F.lit("-"), k).alias("instance_id")
    rows = t.supplier.select(instance, F.col("s_suppkey").alias("row_index"), form.alias("form"), k.alias("k"), name.alias("name"))
    run = F.when(F.col("form") == 0, F.concat("instance_id", F.lit("_run1"))).when(F.col("form") == 1, F.concat(F.lit("run"), "k")).when(F.col("form") == 2, F.concat("instance_id", F.lit("x"))).otherwise(F.col("instance_id"))
    image = F.when(F.col("form") == 1, F.concat(F.lit("sweb.eval.x86_64.A_1776_"), "name", F.lit("-"), "k"))
    return matching.resolve_instances(rows.select(run.alias("trajectory_id"), image.alias("image")), rows.where("form <> 3").select("instance_id", "row_index"), rows.where("form = 3").select("instance_id", "row_index"))
