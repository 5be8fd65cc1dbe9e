"""Path functions as column expressions; backslashes count as slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashes(p: Column) -> Column:
    return F.replace(p, F.lit("\\"), F.lit("/"))


def depth(p: Column) -> Column:
    return F.regexp_count(slashes(p), F.lit("/"))


def basename(p: Column) -> Column:
    return F.substring_index(F.rtrim(slashes(p), F.lit("/")), "/", -1)


def parent(p: Column) -> Column:
    """The directory, "." for a path without a slash."""
    s = slashes(p)
    return F.when(F.contains(s, F.lit("/")), F.coalesce(F.nullif(F.regexp_replace(s, "/+[^/]*$", ""), F.lit("")), F.lit("/"))).otherwise(F.lit("."))


def first_segment(p: Column) -> Column:
    return F.substring_index(F.btrim(slashes(p), F.lit("/")), "/", 1)


def extension(p: Column) -> Column:
    """Lower-case suffix without its dot, '' if none; a leading dot begins no suffix."""
    return F.lower(F.regexp_extract(basename(p), r"[^.]\.([^.]+)$", 1))


def is_test(p: Column) -> Column:
    """``test_*`` names, or below a ``tests`` directory that isn't the root of the path."""
    return F.startswith(basename(p), F.lit("test_")) | F.contains(slashes(p), F.lit("/tests/"))


def is_python(p: Column) -> Column:
    return F.endswith(F.lower(p), F.lit(".py"))


def path_tokens(p: Column) -> Column:
    return F.regexp_extract_all(F.lower(slashes(p)), F.lit("[a-z0-9]+"), F.lit(0))
