"""Messages of trajectories: parsing, issue texts, behaviour up to the first right file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FILE_PATH, ISSUE_BLOCK, py_strip

NOTHING = "array<struct<role:string,text:string,plain:boolean,name:string>>"
OPENS, EDITS = "open|read|view", "edit|write|apply_patch|replace"
PASSED, FAILED = "passed|ok|all tests passed|0 failed", "failed|traceback|error|assertionerror"


def messages(c: Column) -> Column:
    """A JSON array of messages as structs: role, text (chunks of a list joined by newlines), plain (content is a
    string) and name (of a tool, lower case).  What is no array of messages is empty."""
    v = F.try_parse_json(c)
    items = F.try_variant_get(v, "$", "array<variant>")

    def one(m: Column) -> Column:
        text = F.try_variant_get(m, "$.content", "string")
        plain = F.schema_of_variant(F.try_variant_get(m, "$.content", "variant")) == "STRING"
        chunks = F.try_variant_get(m, "$.content", "array<variant>")
        kept = F.filter(F.transform(chunks, lambda k: F.when(F.schema_of_variant(F.try_variant_get(k, "$.text", "variant")) == "STRING", F.try_variant_get(k, "$.text", "string"))), lambda s: s.isNotNull())
        name = F.coalesce(*(F.when(F.schema_of_variant(F.try_variant_get(m, p, "variant")) == "STRING", F.try_variant_get(m, p, "string")) for p in ("$.name", "$.tool_name")))
        return F.struct(
            F.try_variant_get(m, "$.role", "string").alias("role"), F.when(plain, text).otherwise(F.coalesce(F.array_join(kept, "\n"), F.lit(""))).alias("text"),
            F.coalesce(plain, F.lit(False)).alias("plain"), F.lower(F.coalesce(name, F.lit(""))).alias("name"),
        )

    return F.coalesce(F.transform(items, one), F.array().cast(NOTHING))


def issue_text(parsed: Column) -> Column:
    """The block of the first user message that has one, else the first user message; '' without any."""
    mine = F.transform(F.filter(parsed, lambda m: (m["role"] == "user") & m["plain"]), lambda m: m["text"])
    block = F.try_element_at(F.filter(mine, lambda s: s.rlike(ISSUE_BLOCK)), F.lit(1))
    return F.coalesce(py_strip(F.regexp_extract(block, ISSUE_BLOCK, 1)), py_strip(F.try_element_at(mine, F.lit(1))), F.lit(""))


def issue_block_found(parsed: Column) -> Column:
    return F.exists(parsed, lambda m: (m["role"] == "user") & m["plain"] & m["text"].rlike(ISSUE_BLOCK)).cast("int")


def prompt_text(statement: Column, base_statement: Column, raw: Column) -> Column:
    """The first of: the statement, the base's, the first user message, and raw text that isn't JSON."""
    parsed = messages(raw)
    first = F.try_element_at(F.filter(parsed, lambda m: m["role"] == "user"), F.lit(1))["text"]
    filled = lambda c: F.when(py_strip(c) != "", py_strip(c))
    return F.coalesce(filled(statement), filled(base_statement), filled(first), F.when(F.try_parse_json(raw).isNull(), filled(raw)), F.lit(""))


def behaviour(rows: DataFrame, key: str, order: str, text: str, tool: str, primary: str) -> DataFrame:
    """Six features per trajectory from its messages as rows; ``primary`` is its primary patch file, in each row.

    An edit message that opens files too still counts as opened before the edit.  Touches are mentions of
    a path, one per message.  Without the right file its index and the touches before it are null.
    """
    lower, name = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(F.coalesce(F.col(tool), F.lit("")))
    paths = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(FILE_PATH), F.lit(0)))
    tests = lower.rlike("pytest|unittest") | F.contains(name, F.lit("test"))
    rows = rows.select(
        key, order, paths.alias("paths"), F.col(primary).alias("primary"), (F.contains(lower, F.lit("process_control")) | F.contains(name, F.lit("process_control"))).alias("control"),
        name.rlike(OPENS).alias("opens"), name.rlike(EDITS).alias("edits"), F.when(tests, F.when(lower.rlike(PASSED), 1).when(lower.rlike(FAILED), 0)).alias("test"),
    )
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "edited": F.coalesce(F.max(F.col("edits").cast("int")).over(before), F.lit(0)) == 1, "touched": F.coalesce(F.sum(F.size("paths")).over(before), F.lit(0)),
        "right": (F.col("primary") != "") & F.array_contains("paths", F.col("primary")), "index": F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1,
    })
    first = lambda c, when: F.min_by(c, F.when(when, F.col("index")))
    whole = rows.groupBy(key).agg(
        first("test", F.col("test").isNotNull()).alias("traj_first_test_run_success"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("opens") & ~F.col("edited"), F.col("paths")))))).alias("traj_files_opened_before_first_edit"),
        F.sum(F.col("control").cast("int")).alias("traj_process_control_frequency"), F.min(F.when(F.col("right"), F.col("index"))).alias("traj_time_to_first_correct_file_index"),
        first("touched", F.col("right")).alias("traj_touches_before_first_correct_file"),
    )
    each = rows.select(key, F.explode("paths").alias("path")).groupBy(key, "path").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum(F.col("n") - 1).alias("traj_repeated_edits_same_file_count"))
    return whole.join(each, key, "left").na.fill(0, ["traj_repeated_edits_same_file_count"])
