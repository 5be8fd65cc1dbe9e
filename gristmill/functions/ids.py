"""Run, task and repository identifiers as column expressions; no match gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import RUN_SUFFIX, first_text, missing_text, py_strip

# The forms that identifiers have.
INCOMPLETE = r"_incomplete_\d{8}_\d{6}$"
HEX40 = r"[0-9a-fA-F]{40}"
PULL_ID = r"^([^_]+)__([A-Za-z0-9_]+)_([0-9a-fA-F]+)_pr_(\d+)$"
DOTTED_ID = r"^[^_]+__([^.]+)\.([0-9a-fA-F]+)\."
EVAL_IMAGE = r"(?i)sweb\.eval\.x86_64\.([^_]+)_\d+_(.+)-(\d+)$"
HEX8 = r"([0-9a-fA-F]{8,40})"
SLUG = r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"
SHORTEST_SHA = 7


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def without_run(c: Column) -> Column:
    return F.regexp_replace(c, RUN_SUFFIX, "")


def task_id(c: Column) -> Column:
    """The trimmed trajectory id without its run suffix; '' for null."""
    return F.coalesce(without_run(py_strip(c)), F.lit(""))


def without_incomplete(c: Column) -> Column:
    return F.regexp_replace(without_run(c), INCOMPLETE, "")


def separator_free(c: Column) -> Column:
    """Lower case, suffixes removed, runs of dots and underscores one underscore, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), INCOMPLETE, ""), RUN_SUFFIX, "")
    return F.btrim(F.regexp_replace(F.replace(s, F.lit("."), F.lit("_")), "_+", "_"), F.lit("_"))


def repo_sha_of_run(c: Column) -> Column:
    """``repo.sha`` of ``org__repo_sha__rest``."""
    head = F.regexp_extract(without_run(c), r"^.*?__(.*?)__", 1)
    bits = F.split(F.lower(head), "_", -1)
    whole = (F.try_element_at(bits, F.lit(1)) != "") & (F.try_element_at(bits, F.lit(2)) != "")
    return F.when(whole, F.concat_ws(".", F.try_element_at(bits, F.lit(1)), F.try_element_at(bits, F.lit(2))))


def pull_instance(c: Column) -> Column:
    """``org__repo.sha.pr_N`` of ``org__repo_sha_pr_N``."""
    s = without_incomplete(c)
    return F.when(s.rlike(PULL_ID), F.regexp_replace(s, PULL_ID, "$1__$2.$3.pr_$4"))


def repo_sha_of_instance(c: Column) -> Column:
    return F.when(c.rlike(DOTTED_ID), F.lower(F.concat_ws(".", F.regexp_extract(c, DOTTED_ID, 1), F.regexp_extract(c, DOTTED_ID, 2))))


def repo_of_image(c: Column) -> Column:
    name = F.lower(F.substring_index(F.substring_index(c, ":", 1), "/", -1))
    return F.nullif(F.regexp_replace(name, "_final$", ""), F.lit(""))


def repo_of_run(c: Column, owners: Sequence[str] = ()) -> Column:
    """What stands before the 40 hex digits, without one of ``owners`` (of images) in front and ``final`` at the end."""
    before = F.rtrim(found(without_run(c), rf"^(.*?){HEX40}"), F.lit("_"))
    core = F.regexp_replace(F.lower(before), rf"^(?:{'|'.join(owners)})_", "") if owners else F.lower(before)
    core = F.regexp_replace(core, r"(^|_)final$", "")
    return F.nullif(F.btrim(core, F.lit("_")), F.lit(""))


def commit_of(run: Column, image: Column) -> Column:
    return F.lower(F.coalesce(found(without_run(run), f"({HEX40})"), found(image, f"({HEX40})")))


def owner_repo(c: Column) -> Column:
    """Struct (owner, repo) of ``owner__repo-num``; the last dash counts."""
    whole = r"(?s)^(.*?)__(.*)-[^-]*$"
    owner, repo = F.lower(F.regexp_extract(c, whole, 1)), F.lower(F.regexp_extract(c, whole, 2))
    return F.when(c.rlike(whole) & (owner != "") & (repo != ""), F.struct(owner.alias("owner"), repo.alias("repo")))


def instance_of_image(c: Column) -> Column:
    s = py_strip(c)
    return F.when(s.rlike(EVAL_IMAGE), F.concat(F.regexp_extract(s, EVAL_IMAGE, 1), F.lit("__"), F.regexp_extract(s, EVAL_IMAGE, 2), F.lit("-"), F.regexp_extract(s, EVAL_IMAGE, 3)))


def mirror_repo(c: Column, owner: str) -> Column:
    """``owner/org__repo.sha8`` of ``org__repo.sha...``, without the sha if there is none; '' without ``__``."""
    rest = F.regexp_extract(c, r"(?s)^.*?__(.*)$", 1)
    org = F.substring_index(c, "__", 1)
    repo = F.substring_index(rest, ".", 1)
    sha = F.left(F.regexp_extract(F.substring(rest, F.length(repo) + 2, F.length(rest)), HEX8, 1), F.lit(8))
    return F.when(F.contains(c, F.lit("__")), F.concat(F.lit(owner + "/"), org, F.lit("__"), repo, F.when(sha != "", F.concat(F.lit("."), sha)).otherwise(F.lit("")))).otherwise(F.lit(""))


def mirror_commit(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, HEX8, 1))


def base_of(source: Column, kinds: Mapping[str, str], mirror_owner: str, commits: Sequence[Column]) -> tuple[Column, Column]:
    """Repository and commit of a run's base row, by its source's kind; '' for sources of no kind and for what is missing.

    "instance" rows give ``repo`` and the first of ``commits`` that has text; "mirror" rows encode both in ``instance_id``;
    "commit" rows give ``repo_name``, or else what the run's ``trajectory_id`` begins with, and ``commit_hash``.
    """
    none, instance = F.lit(""), first_text(F.col("instance_id"))
    by_kind = {
        "instance": (first_text(F.col("repo")), first_text(*commits)),
        "mirror": (mirror_repo(instance, mirror_owner), mirror_commit(instance)),
        "commit": (F.coalesce(F.nullif(first_text(F.col("repo_name")), none), F.substring_index("trajectory_id", "_", 1), none), first_text(F.col("commit_hash"))),
    }
    repo, commit = none, none
    for name, kind in kinds.items():
        repo = F.when(source == name, by_kind[kind][0]).otherwise(repo)
        commit = F.when(source == name, by_kind[kind][1]).otherwise(commit)
    return repo, commit


def repo_commit(repo: Column, commit: Column) -> Column:
    """Struct (repo, commit), commit in lower case: as given for a slug with a commit; else decoded from
    ``org__repo.sha`` with a commit given going first; else as given."""
    encoded = r"^(?:swesmith/)?([A-Za-z0-9_.-]+)__([A-Za-z0-9_.-]+)\.([0-9a-fA-F]{7,40})$"
    r, c = py_strip(F.coalesce(repo, F.lit(""))), F.lower(py_strip(F.coalesce(commit, F.lit(""))))
    pair = lambda a, b: F.struct(a.alias("repo"), b.alias("commit"))
    decoded = pair(F.concat_ws("/", F.regexp_extract(r, encoded, 1), F.regexp_extract(r, encoded, 2)), F.coalesce(F.nullif(c, F.lit("")), F.lower(F.regexp_extract(r, encoded, 3))))
    return F.when((c != "") & r.rlike(SLUG), pair(r, c)).when(r.rlike(encoded), decoded).otherwise(pair(r, c))


def tree_file(repo: Column, sha: Column | None = None) -> Column:
    """File name of a tree snapshot: ``owner__repo[__sha].json.gz``."""
    name = F.replace(repo, F.lit("/"), F.lit("__"))
    return F.concat(name, *([F.lit("__"), sha] if sha is not None else []), F.lit(".json.gz"))


def sha_compatible(a: Column, b: Column) -> Column:
    """Equal, or both of at least seven characters and one the start of the other; blank is never compatible."""
    x, y = F.lower(py_strip(F.coalesce(a, F.lit("")))), F.lower(py_strip(F.coalesce(b, F.lit(""))))
    long = (F.length(x) >= SHORTEST_SHA) & (F.length(y) >= SHORTEST_SHA)
    return (x != "") & (y != "") & ((x == y) | (long & (F.startswith(x, y) | F.startswith(y, x))))


