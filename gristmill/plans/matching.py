"""Cascades, fuzzy and prefix joins, over the tables and over inline rows with expected rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import matching
from .registry import query

@query("SELECT source AS key, min(doc_id) AS first_at, max(doc_id) AS last_at FROM documents WHERE source <> '' GROUP BY 1")
def j15_first_and_last(t):
    rows = t.documents.select("source", F.col("doc_id").alias("row_index"))
    first = matching.index_by(rows, F.col("source")).withColumnRenamed("row_index", "first_at")
    return first.join(matching.index_by(rows, F.col("source"), last=True).withColumnRenamed("row_index", "last_at"), "key")


@query()
def j14_near_urls(t):
    """Each page's address, as if over https and without what follows the path, with the most similar one of its host."""
    url = F.regexp_replace(F.regexp_replace("url", "^http:", "https:"), "[?#].*$", "")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    base = t.pages.select(F.col("page_id").alias("row_index"), "url")
    return matching.fuzzy(t.pages, "page_id", url, host, base, F.col("url"), host, 0.9).withColumn("ratio", F.round("ratio", 6))


@query("""
WITH r AS (SELECT conv_id, turn, ['commits', 'mirror', 'instances', 'other'][1 + turn % 4] AS source, left(md5(text), 10) AS sha, regexp_extract(lower(text), '[a-z]+') AS w FROM conversations),
i AS (SELECT *, CASE WHEN w = '' THEN NULL WHEN conv_id % 7 = 0 THEN 'org' || w ELSE 'org__' || w || CASE WHEN conv_id % 3 = 0 THEN '' ELSE '.' || sha || '.x' END END AS instance_id,
 CASE WHEN conv_id % 2 = 0 THEN ' ' ELSE w END AS repo_name FROM r)
SELECT conv_id, turn, source, CASE source WHEN 'instances' THEN trim('o/' || w) WHEN 'mirror' THEN CASE WHEN instance_id IS NULL OR NOT contains(instance_id, '__') THEN ''
 ELSE 'mirrors/org__' || w || CASE WHEN conv_id % 3 = 0 THEN '' ELSE '.' || left(sha, 8) END END
 WHEN 'commits' THEN CASE WHEN trim(repo_name) <> '' THEN trim(repo_name) ELSE 'run' || conv_id END ELSE '' END AS base_repo,
 CASE source WHEN 'instances' THEN sha WHEN 'mirror' THEN lower(coalesce(regexp_extract(instance_id, '[0-9a-fA-F]{8,40}'), '')) WHEN 'commits' THEN sha ELSE '' END AS base_commit FROM i""")
def f12_base_by_source(t):
    w, conv = F.regexp_extract(F.lower("text"), "[a-z]+", 0), F.col("conv_id")
    rows = t.conversations.select(
        "conv_id", "turn", F.element_at(F.array(*map(F.lit, ("commits", "mirror", "instances", "other"))), (F.col("turn") % 4 + 1).cast("int")).alias("source"), F.left(F.md5("text"), F.lit(10)).alias("sha"), w.alias("w")
    )
    tail = F.when(conv % 3 == 0, "").otherwise(F.concat(F.lit("."), "sha", F.lit(".x")))
    instance = F.when(F.col("w") == "", None).when(conv % 7 == 0, F.concat(F.lit("org"), "w")).otherwise(F.concat(F.lit("org__"), "w", tail))
    rows = rows.withColumns({
        "instance_id": instance, "repo_name": F.when(conv % 2 == 0, " ").otherwise(F.col("w")), "repo": F.concat(F.lit("o/"), "w"),
        "base_commit": F.lit(" "), "commit": F.lit(None).cast("string"), "commit_hash": F.col("sha"), "trajectory_id": F.concat(F.lit("run"), conv, F.lit("_x_y")),
    })
    kinds = {"commits": "commit", "mirror": "mirror", "instances": "instance"}
    repo, commit = ids.base_of(F.col("source"), kinds, "mirrors", [F.col("base_commit"), F.col("commit"), F.col("sha")])
    return rows.select("conv_id", "turn", "source", repo.alias("base_repo"), commit.alias("base_commit"))
