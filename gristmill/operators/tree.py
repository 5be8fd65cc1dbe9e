"""Features of file-tree snapshots, linking of texts to paths: expressions over arrays, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, depth, first_segment, is_python, is_test, parent, path_tokens, slashes
from ..functions.text import identifiers, jaccard, ratio, word_tokens


def _mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)).otherwise(F.lit(0.0))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def blob_paths(tree: Column) -> Column:
    blobs = F.filter(F.coalesce(tree, _none("struct<path:string,type:string,size:bigint>")), lambda e: (e["type"] == "blob") & (e["path"] != ""))
    return F.transform(blobs, lambda e: e["path"])


def tree_features(df: DataFrame, tree: str = "tree", truncated: str = "truncated", changed: str = "changed_files") -> DataFrame:
    """Adds 18 features of the array of entries in ``tree``; a null tree counts as empty, with tree_present 0.

    Directory counts, the deepest path and top-level names come from all entries, so a file at the top
    counts as a name too.  Means over changed files are null without any.
    """
    given = set(df.columns)
    entries = F.coalesce(F.col(tree), _none("struct<path:string,type:string,size:bigint>"))
    df = df.withColumns({"__e": entries, "__c": F.coalesce(F.col(changed), _none("string"))})
    of = lambda kind: F.filter("__e", lambda e: e["type"] == kind)
    df = df.withColumns({"__blobs": of("blob"), "__p": blob_paths(F.col("__e")), "__all": F.filter(F.transform("__e", lambda e: e["path"]), lambda p: p.isNotNull())})
    df = df.withColumns({
        "__sizes": F.filter(F.transform("__blobs", lambda e: e["size"]), lambda s: s.isNotNull()), "__names": F.transform("__p", basename), "__parents": F.transform("__p", parent),
    })
    files, paths = F.size("__blobs"), F.col("__p")
    top = lambda name: F.exists("__all", lambda p: (slashes(p) == name) | F.startswith(slashes(p), F.lit(name + "/"))).cast("int")
    # a name that stands more than once is the second of its run in sorted order, once
    run = F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("n"), F.lit(0).alias("repeated"))

    def following(s: Column, name: Column) -> Column:
        n = F.when(s["name"] == name, s["n"] + 1).otherwise(1)
        return F.struct(name.alias("name"), n.alias("n"), (s["repeated"] + F.when(n == 2, 1).otherwise(0)).alias("repeated"))

    repeated = F.aggregate(F.sort_array("__names"), run, following, lambda s: s["repeated"])
    siblings = F.transform("__c", lambda c: F.size(F.filter("__parents", lambda p: p == parent(c))))
    have = F.size("__c") > 0
    out = {
        "tree_present": F.col(tree).isNotNull().cast("int"), "tree_truncated": F.coalesce(F.col(truncated), F.lit(False)).cast("int"),
        "repo_file_count": files, "repo_dir_count": F.size(of("tree")), "repo_max_depth": F.coalesce(F.array_max(F.transform("__all", depth)), F.lit(0)),
        "repo_mean_file_depth": _mean(F.transform(paths, depth)), "repo_python_file_count": F.size(F.filter(paths, is_python)), "repo_test_file_count": F.size(F.filter(paths, is_test)),
        "repo_test_ratio": ratio(F.size(F.filter(paths, is_test)), files), "repo_total_known_size": F.aggregate("__sizes", F.lit(0).cast("long"), lambda s, x: s + x),
        "repo_mean_known_file_size": _mean(F.col("__sizes")), "repo_top_level_dir_count": F.size(F.array_distinct(F.transform(F.filter("__all", lambda p: p != ""), first_segment))),
        "repo_has_docs_dir": top("docs"), "repo_has_tests_dir": top("tests"), "repo_has_examples_dir": top("examples"), "repo_basename_collision_count": repeated,
        "repo_mean_siblings_per_changed_file": F.when(have & (F.size(paths) > 0), _mean(siblings)),
        "repo_changed_files_exist_in_tree_ratio": F.when(have, F.size(F.filter("__c", lambda c: F.array_contains(paths, c))).cast("double") / F.size("__c")),
    }
    return df.withColumns(out).drop(*(c for c in df.columns if c not in given))


def linking_features(df: DataFrame, text: str, changed: str = "changed_files", blobs: str = "blob_paths") -> DataFrame:
    """Adds how a text's words and identifiers meet changed paths and the tree's paths; the rank of changed files
    among the tree's by shared words is null where none is in the tree."""
    paths = lambda c: F.coalesce(F.col(c), _none("string"))
    tokens = lambda c: F.array_distinct(F.flatten(F.transform(paths(c), path_tokens)))
    df = df.withColumns({"__w": word_tokens(F.col(text)), "__pt": tokens(changed), "__tt": tokens(blobs), "__ids": identifiers(F.col(text)), "__pi": F.array_distinct(F.flatten(F.transform(paths(changed), identifiers)))})
    shared = lambda p: F.size(F.array_intersect(F.array_distinct(path_tokens(p)), F.col("__w")))
    df = df.withColumn("__ranked", F.array_sort(F.transform(paths(blobs), lambda p: F.struct((-shared(p)).alias("s"), p.alias("p")))))
    near = F.filter("__ranked", lambda r: r["s"] < 0)
    ranks = F.filter(F.transform("__ranked", lambda r, i: F.when(F.array_contains(paths(changed), r["p"]), i + 1)), lambda r: r.isNotNull())
    return df.withColumns({
        "prompt_patch_filename_token_overlap": jaccard(F.col("__w"), F.col("__pt")), "prompt_tree_filename_token_overlap": jaccard(F.col("__w"), F.col("__tt")),
        "prompt_patch_identifier_overlap_count": F.size(F.array_intersect("__ids", "__pi")), "prompt_tree_candidate_file_count": F.size(near),
        "prompt_tree_candidate_dir_count": F.size(F.array_distinct(F.transform(near, lambda r: parent(r["p"])))), "changed_file_candidate_rank_min": F.array_min(ranks),
    }).drop("__w", "__pt", "__tt", "__ids", "__pi", "__ranked")
