"""Plot data over the vectors as attributions: a row a vector, a feature a component."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plots
from .registry import query, rounded

LONG = """WITH v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS phi FROM embeddings)"""


def components(t):
    return t.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "label", "pos", F.col("x").cast("double").alias("phi"))


@query(LONG + """,
q AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(phi) DESC, CAST(pos AS VARCHAR)) AS nth, count(*) OVER (PARTITION BY vec_id) AS n FROM v),
p AS (SELECT *, CAST(least(nth, 15) AS INTEGER) AS place FROM q),
b AS (SELECT vec_id, place, CASE WHEN any_value(n) > 15 AND place = 15 THEN 'others' ELSE any_value(CAST(pos AS VARCHAR)) END AS feature, count(*) AS features, sum(phi) AS phi FROM p GROUP BY 1, 2),
e AS (SELECT *, 0.5 + sum(phi) OVER (PARTITION BY vec_id ORDER BY place DESC) AS done FROM b)
SELECT vec_id, place, feature, features, round(phi, 6) AS phi, round(done - phi, 6) AS start, round(done, 6) AS "end" FROM e""")
def x9_waterfalls(t):
    return rounded(plots.waterfall(components(t), "vec_id", "pos", "phi", F.lit(0.5)), "phi", "start", "end")


@query(LONG + """,
r AS (SELECT *, min(phi) OVER f AS lo, max(phi) OVER f AS hi, min(label) OVER f AS l0, max(label) OVER f AS l1 FROM v WINDOW f AS (PARTITION BY pos))
SELECT CAST(pos AS INTEGER) AS pos, CAST(least(floor((phi - lo) / (hi - lo) * 50), 49) AS INTEGER) AS x_bin, CAST(CASE WHEN l0 = l1 THEN 0 ELSE least(floor((label - l0) / CAST(l1 - l0 AS DOUBLE) * 50), 49) END AS INTEGER) AS y_bin,
 count(*) AS n, round(avg(vec_id), 6) AS color FROM r GROUP BY 1, 2, 3""")
def x9_density(t):
    return rounded(plots.density(components(t), ["pos"], "phi", "label", color="vec_id"), "color")


@query(LONG + """,
s AS (SELECT a.pos AS a, b.pos AS b, avg(abs(a.phi * b.phi)) AS strength FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.pos > a.pos GROUP BY 1, 2),
u AS (SELECT a AS feature, b AS partner, strength FROM s UNION ALL SELECT b, a, strength FROM s)
SELECT CAST(feature AS INTEGER) AS feature, CAST(arg_max(partner, strength) AS INTEGER) AS partner, round(max(strength), 6) AS strength FROM u GROUP BY 1""")
def x9_partners(t):
    """The strength of a pair of components is the mean product of their sizes; features of a row are paired, 64 of them."""
    pairs = F.flatten(F.transform("embedding", lambda x, i: F.transform("embedding", lambda y, j: F.struct(i.alias("a"), j.alias("b"), F.abs(x.cast("double") * y.cast("double")).alias("s")))))
    rows = t.embeddings.select(F.explode(F.filter(pairs, lambda p: p["a"] < p["b"])).alias("p")).select("p.*")
    return rounded(plots.partners(rows.groupBy("a", "b").agg(F.avg("s").alias("s")), "a", "b", "s"), "strength")
