"""Model and attribution queries; values of fitted models have no SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import boosting, models, shap
from .registry import query, rounded

FEATURES = ["chars", "lines", "words", "marks"]


def labelled(t):
    d = t.documents.join(t.labels.select("doc_id", F.col("quality").alias("y")), "doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    return d.select("doc_id", "y", F.length(text).cast("double").alias("chars"), F.size(F.split(text, "\n")).cast("double").alias("lines"), F.size(F.split(text, " ")).cast("double").alias("words"), F.regexp_count(text, F.lit("[!|%$*]")).cast("double").alias("marks"))


def predicted(t, fit):
    rows = labelled(t)
    return rounded(fit(rows.where("doc_id % 5 <> 0"), FEATURES, "y").predict(rows.where("doc_id % 5 = 0")).select("doc_id", "y", "p"), "p")


@query()
def m1_logistic(t):
    return predicted(t, models.logistic)


@query()
def m2_ridge(t):
    return predicted(t, models.ridge)


@query()
def m3_forest(t):
    return predicted(t, partial(models.forest, numTrees=20, maxDepth=6))


@query()
def m4_boosted(t):
    return predicted(t, partial(models.boosted, maxIter=10))


@query("""
WITH r AS (
  SELECT d.doc_id, l.quality AS y, coalesce(d.text, '') AS t FROM documents d JOIN labels l USING (doc_id)),
v AS (
  SELECT 0 AS feature, y, CAST(length(t) AS DOUBLE) AS x FROM r UNION ALL SELECT 1, y, len(string_split(t, chr(10))) FROM r
  UNION ALL SELECT 2, y, len(string_split(t, ' ')) FROM r UNION ALL SELECT 3, y, len(regexp_extract_all(t, '[!|%$*]')) FROM r),
q AS (SELECT feature, list_distinct(quantile_cont(x, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS cuts FROM v GROUP BY 1),
b AS (
  SELECT v.feature, CAST(len(list_filter(cuts, lambda c: c < x)) AS INTEGER) AS bin, sum(m.p - y) AS g, sum(m.p * (1 - m.p)) AS h, count(*) AS n
  FROM v JOIN q ON v.feature = q.feature, (SELECT avg(y) AS p FROM r) m GROUP BY 1, 2),
s AS (
  SELECT *, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(g) OVER o AS gt, sum(h) OVER o AS ht, sum(n) OVER u AS nl, sum(n) OVER o AS nt
  FROM b WINDOW u AS (PARTITION BY feature ORDER BY bin), o AS (PARTITION BY feature))
SELECT feature, bin, n, round(gl, 6) AS gl, round(hl, 6) AS hl,
       CASE WHEN nl < nt AND hl >= 1 AND ht - hl >= 1 THEN round(0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)), 6) END AS gain
FROM s""")
def m4_first_split_gains(t):
    rows = labelled(t)
    cuts = boosting.cut_points(rows, FEATURES, 8)
    mean = rows.agg(F.avg("y").alias("m"))  # one row
    binned = rows.select(F.col("y").cast("double").alias("y"), *(boosting.bin_of(f, cuts[f]).alias(f"b{i}") for i, f in enumerate(FEATURES))).crossJoin(F.broadcast(mean))
    binned = binned.withColumn("margin", F.log(F.col("m") / (1 - F.col("m")))).withColumns(boosting.gradients("classification"))
    gains = boosting.split_gains(boosting.histograms(binned, F.lit(0), range(len(FEATURES))), 1.0, 1.0)
    return rounded(gains.select("feature", "bin", "n", "gl", "hl", "gain"), "gl", "hl", "gain")


@query()
def m4_second_order(t):
    rows = labelled(t)
    model = boosting.boost(rows, FEATURES, "y", trees=4, depth=3, rate=0.3, key="doc_id")
    return rounded(model.predict(rows).select("doc_id", "y", "p"), "p")


@query()
def m5_search(t):
    rows = labelled(t)
    fit = partial(models.forest, kind="classification")
    _, params, best = models.search(rows, FEATURES, "y", "classification", fit, {"numTrees": (5, 10), "maxDepth": (3, 5)}, n_iter=2, inner=2, key="doc_id")
    return t.spark.createDataFrame([(str(sorted(params.items())), float(best))], "params string, best double")


@query()
def m6_nested(t):
    fit = partial(models.logistic, max_iter=50)
    out = models.nested(labelled(t), FEATURES, "y", "classification", lambda df, f, y, C: fit(df, f, y, C=C), {"C": frozenset((1e-2, 1e2))}, outer=2, n_iter=2, inner=2, key="doc_id")  # noqa: N803
    return t.spark.createDataFrame([(r["fold"], float(r["score"])) for r in out], "fold int, score double")


@query()
def m7_cross_validated(t):
    return models.cross_validated(labelled(t), FEATURES, "y", "classification", partial(models.logistic, max_iter=50), k=3, key="doc_id").select("doc_id", "fold", "p")


@query()
def m16_importance(t):
    model = models.forest(labelled(t), FEATURES, "y", numTrees=20, maxDepth=6)
    return t.spark.createDataFrame([(k, float(v)) for k, v in model.importances().items()], "feature string, importance double")


@query()
def a6_ablation(t):
    rows = labelled(t)
    families = {"size": ["chars", "words"], "shape": ["lines", "marks"], "none": []}
    out = models.ablation(rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0"), families, {"y": "classification"}, partial(models.boosted, maxIter=5))
    return t.spark.createDataFrame([(r["target"], r["components"], r["n_features"], r["skipped"], r.get("roc_auc")) for r in out], "target string, components string, n_features int, skipped boolean, roc_auc double")


@query()
def x1_tree_shap(t):
    rows = labelled(t)
    phi, _ = shap.attributions(models.boosted(rows, FEATURES, "y", maxIter=5), rows, "doc_id")
    return shap.long_table(phi, "doc_id", FEATURES)


@query()
def x2_interactions(t):
    rows = labelled(t)
    return shap.interaction_strengths(models.boosted(rows, FEATURES, "y", maxIter=5), shap.seeded_sample(rows, "doc_id", 100))


@query("SELECT true AS additive")
def x4_additivity(t):
    rows = labelled(t)
    model = models.boosted(rows, FEATURES, "y", maxIter=5)
    phi, expected = shap.attributions(model, rows, "doc_id")
    return shap.additivity(phi, model.predict(rows), "doc_id", expected).select((F.col("worst") <= 1e-2).alias("additive"))


@query("SELECT doc_id FROM (SELECT doc_id FROM labels ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id LIMIT 50)")
def x8_seeded_sample(t):
    return shap.seeded_sample(t.labels, "doc_id", 50).select("doc_id")
