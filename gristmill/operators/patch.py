"""Features of unified diffs: sections of files as rows, their lines counted by patterns over a section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension, is_python, is_test
from ..functions.text import LINE_END, missing_text, py_lines, py_strip, ratio

# What counts as a header, a definition, a branch and a syntax node.  All but the first look at lines of a
# section, which end with \n only, from the sign of a changed one on.
HUNK = r"^@@\s+-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s+@@"
ADDED, DELETED = r"^\+(?!\+\+)", r"^-(?!--)"
CHANGED = rf"(?:{ADDED}|{DELETED})"
DEFINITION = r"[ \t]*(?:async[ \t]+def|def)[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*\("
CLASS = r"[ \t]*class[ \t]+([A-Za-z_][A-Za-z0-9_]*)\b"
BRANCH = r"[ \t]*(?:if|elif|for|while|match|case|try|except|with)\b"
NODE = r"[ \t]*(?:async[ \t]+def|def|class|if|elif|for|while|match|case|try|except|with|return|raise|import|from|lambda)\b"
SAID = r"[^\n]*[^\s\x1c-\x1f]"
GIT = "diff --git "


def header_path(line: Column) -> Column:
    """The path of an unquoted ``diff --git a/p b/p`` line, null for others and for renames."""
    rest = py_strip(F.substring(line, len(GIT) + 1, 1 << 30))
    left, right = F.regexp_extract(rest, "^a/(.*?) b/(.*)$", 1), F.regexp_extract(rest, "^a/(.*?) b/(.*)$", 2)
    return F.when(F.startswith(line, F.lit(GIT)) & rest.rlike("^a/.*? b/") & (left == right), left)


def changed_files(patch: Column) -> Column:
    """Paths of the headers, in order, repeats kept; none for a missing patch."""
    lines = F.when(missing_text(patch), F.array().cast("array<string>")).otherwise(py_lines(patch))
    return F.filter(F.transform(F.filter(lines, lambda line: F.startswith(line, F.lit(GIT))), header_path), lambda p: p.isNotNull())


def patch_sections(df: DataFrame, key: str, patch: str) -> DataFrame:
    """One row per section, what precedes the first header is one if there is any, and a patch without lines has one without text:
    n, section (lines end with \\n), file (its header's), present (of the patch)."""
    text = F.when(F.col(key).isNotNull(), F.coalesce(F.col(patch), F.lit(""))).otherwise("")
    cut = F.split(F.regexp_replace(text, LINE_END, "\n"), rf"(?m)^(?={GIT})", -1)
    rows = df.select(key, (~missing_text(F.col(patch))).cast("int").alias("present"), F.posexplode_outer(cut).alias("n", "section"))
    return rows.withColumn("file", header_path(F.substring_index("section", "\n", 1)))


def patch_features(df: DataFrame, key: str = "patch_id", patch: str = "patch") -> DataFrame:
    """One row per row of ``df``, whose keys are unique: 31 features of its patch.

    ``patch_num_files_changed`` counts headers, so a repeated one counts again.  Lines that start with
    ``+++`` or ``---`` never count, even inside hunks.  A missing patch has patch_present 0 and zeros.

    Sections are made once: they are summed by file, files by patch, without a shuffle besides that by key.
    """
    section, f = F.col("section"), F.col("file")
    count = lambda c: F.sum(c.cast("long"))
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")
    every = lambda p: F.regexp_count(section, F.lit(f"(?m){p}"))
    names = lambda p: F.when(f.isNotNull(), F.array_distinct(F.regexp_extract_all(section, F.lit(f"(?m){CHANGED}{p}"), F.lit(1))))
    parts = F.split(section, "(?m)^(?=@@)", -1)
    at = lambda line, g: F.regexp_extract(line, HUNK, g)
    heads = F.filter(F.transform(F.filter(parts, lambda x: F.startswith(x, F.lit("@@"))), lambda x: F.substring_index(x, "\n", 1)), lambda x: x.rlike(HUNK))
    hunks = F.transform(heads, lambda x: F.struct(
        at(x, 3).try_cast("long").alias("start"), F.greatest(*(F.coalesce(F.nullif(at(x, g), F.lit("")).try_cast("long"), F.lit(1)) for g in (2, 4))).alias("span"),
    ))
    # lines of a part from its first definition on
    counted = F.transform(parts, lambda x: F.regexp_count(F.regexp_extract(x, f"(?ms){CHANGED}{DEFINITION}.*", 0), F.lit(f"(?mU){CHANGED}{SAID}")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    sections = patch_sections(df, key, patch).select(
        key, "present", "n", "file", F.startswith(section, F.lit(GIT)).alias("header"), every("^@@").alias("hunks"), every(ADDED).alias("added"), every(DELETED).alias("deleted"),
        names(DEFINITION).alias("defs"), names(CLASS).alias("classes"), every(CHANGED + NODE).alias("nodes"), every(ADDED + BRANCH).alias("branches"), every(DELETED + BRANCH).alias("branches_less"),
        hunks.alias("at"), "section",
    )
    sections = sections.withColumns({"counted": F.when(F.size("defs") > 0, total(counted)).otherwise(0), "span": total(F.col("at.span")), "spans": F.size("at"), "starts": F.filter("at.start", lambda x: x.isNotNull())}).drop("section", "at")
    # within a file; a definition stands in one
    several = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    files = sections.groupBy(key, "file").agg(
        F.max("present").alias("present"), count(F.col("header")).alias("headers"), *(count(F.col(c)).alias(c) for c in ("hunks", "added", "deleted", "nodes", "branches", "branches_less", "counted", "spans")), F.sum("span").alias("span"),
        several("defs").alias("defs"), several("classes").alias("classes"), F.flatten(F.transform(F.sort_array(F.collect_list(F.when(f.isNotNull(), F.struct("n", "starts")))), lambda x: x["starts"])).alias("starts"),
    ).withColumn("counted_defs", F.col("defs"))  # a definition is a line that counts
    gaps = F.transform(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), lambda x, i: F.greatest(x - F.get("starts", i), F.lit(0)))
    depth = F.regexp_count(f, F.lit("/"))
    clean = F.btrim(F.replace(f, F.lit("\\"), F.lit("/")), F.lit("/"))
    folder = F.when(F.contains(clean, F.lit("/")), F.regexp_replace(clean, "/+[^/]*$", "")).otherwise(".")
    files = files.withColumns({"gap": F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), "gaps": F.greatest(F.size("starts") - 1, F.lit(0)), "depth": depth, "churn": F.when(f.isNotNull(), F.col("added") + F.col("deleted"))})
    w = F.when(F.col("churn") > 0, F.col("churn").cast("double"))
    mean = lambda n, d: ratio(F.sum(n), F.sum(d))
    c = F.col
    out = files.groupBy(key).agg(
        F.max("present").alias("patch_present"), F.sum(F.when(f.isNotNull(), c("headers"))).alias("patch_num_files_changed"), F.sum("hunks").alias("patch_num_hunks"),
        F.sum("added").alias("patch_lines_added"), F.sum("deleted").alias("patch_lines_deleted"), F.sum("defs").alias("ast_num_functions_modified"), F.sum("classes").alias("ast_num_classes_modified"),
        F.sum("nodes").alias("ast_syntax_node_change_count"), F.sum("branches").alias("cfg_conditionals_added"), F.sum("branches_less").alias("cfg_conditionals_deleted"),
        mean("counted", "counted_defs").alias("func_avg_changed_lines_per_touched_function"), mean("span", "spans").alias("func_avg_hunk_span_modified"), mean("gap", "gaps").alias("patch_hunk_gap_mean"),
        distinct(F.when(f.isNotNull(), folder)).alias("patch_num_unique_dirs_changed"), F.max("depth").cast("long").alias("patch_max_file_depth"), F.avg("depth").alias("patch_mean_file_depth"),
        distinct(extension(f)).alias("patch_extensions_changed_count"), count(is_python(f)).alias("patch_python_files_changed"),
        count(is_test(f)).alias("patch_test_files_changed"), count(~is_test(f)).alias("patch_src_files_changed"),
        F.min_by(F.when(c("churn") > 0, f), F.when(c("churn") > 0, F.struct(-c("churn"), f))).alias("patch_primary_file_path"),
        # as many files as headers name, so that one changed file among several still has entropy 0
        F.count("file").alias("__files"), F.sum(w).alias("__whole"), F.sum(w * F.log(w)).alias("__weighed"), F.sort_array(F.collect_list("churn")).alias("__churns"),
    )
    spread = F.greatest(F.lit(0.0), (F.log("__whole") - c("__weighed") / c("__whole")) / F.log(F.lit(2.0)))
    placed = F.aggregate(F.transform("__churns", lambda x, i: (i + 1) * x), F.lit(0).cast("long"), lambda s, x: s + x)
    uneven = F.when((c("__files") > 1) & (c("__whole") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * placed / (c("__files") * c("__whole")) - (c("__files") + 1.0) / c("__files"))))
    out = out.withColumns({"patch_entropy_over_files": F.when(c("__files") > 1, spread), "patch_churn_gini_over_files": uneven}).drop("__files", "__whole", "__weighed", "__churns")
    out = out.na.fill(0, [n for n in out.columns if n != key]).na.fill("", ["patch_primary_file_path"])
    return out.withColumns({
        "patch_primary_file_depth": F.regexp_count("patch_primary_file_path", F.lit("/")), "patch_edit_fragmentation": ratio(c("patch_num_hunks"), c("patch_num_files_changed")),
        "ast_edit_distance_proxy": (c("ast_num_functions_modified") + c("ast_num_classes_modified") + c("ast_syntax_node_change_count")).cast("double"),
        "cfg_conditionals_delta": c("cfg_conditionals_added") - c("cfg_conditionals_deleted"), "cfg_conditionals_total_changed": c("cfg_conditionals_added") + c("cfg_conditionals_deleted"),
        "func_num_functions_touched": c("ast_num_functions_modified"), "patch_lines_changed_total": c("patch_lines_added") + c("patch_lines_deleted"),
        "patch_is_single_file": (c("patch_num_files_changed") == 1).cast("int"),
    })
