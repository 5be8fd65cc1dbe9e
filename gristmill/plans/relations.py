"""Sources, joins, aggregations, top rows and set operations over the proxy tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import first_text, ratio
from ..operators import ranking, relational, rollup, split, vif
from ..sources import tables
from .registry import query, rounded


@query("""
SELECT o_custkey AS task_id, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, count(*) AS n_runs,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_success,
  max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS any_success,
  CASE WHEN avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 1 ELSE 0 END AS maj_success
FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1""")
def g1_task_outcomes(t):
    runs = t.orders.select(F.col("o_custkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("reward"))
    return rounded(rollup.task_outcomes(runs), "pass_rate")


@query("""
SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, arg_min(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value
FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def g2_first_non_null_meta(t):
    return rollup.first_non_null(t.events, ["user_id"], ["event_type", "value"], F.struct("ts", "event_id"))


@query("""
SELECT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def g3_keep_first(t):
    return relational.first_row(t.events.select("event_id", "ts", "user_id", "event_type", "value"), ["user_id"], F.struct("ts", "event_id")).select("event_id", "user_id", "event_type", "value")


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def g4_distinct_pairs(t):
    return t.orders.select("o_custkey", "o_orderpriority").distinct()


@query("""
SELECT c_nationkey, round(avg(c_acctbal), 6) AS c_acctbal, CAST(sum(c_custkey) AS BIGINT) AS c_custkey, count(*) AS n_tasks
FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1""")
def g5_group_rollup(t):
    return rounded(rollup.group_rollup(t.customer, "c_nationkey", ["c_acctbal"], [], ["c_custkey"]), "c_acctbal")


@query("""
SELECT count(*) AS n_tasks, round(avg(o_totalprice), 4) AS pass_rate_mean, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 4) AS any_success_mean,
  round(avg(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END), 4) AS maj_success_mean, count(DISTINCT o_custkey) AS n_repositories FROM orders""")
def g6_dataset_summary(t):
    status = lambda s: (F.col("o_orderstatus") == s).cast("int")
    tasks = t.orders.select(F.col("o_totalprice").alias("pass_rate"), status("F").alias("any_success"), status("O").alias("maj_success"), "o_custkey", "o_orderpriority")
    return rounded(rollup.dataset_summary(tasks, "o_custkey", "o_orderpriority")[0], "pass_rate_mean", "any_success_mean", "maj_success_mean", digits=4)


@query("SELECT o_orderpriority AS source, count(*) AS n_tasks FROM orders GROUP BY 1")
def g6_tasks_by_source(t):
    tasks = t.orders.select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("repo"), *(F.lit(1.0).alias(c) for c in ("pass_rate", "any_success", "maj_success")))
    return rollup.dataset_summary(tasks, "repo", "source")[1]


@query("""
SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
  round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75
FROM lineitem GROUP BY 1""")
def g7_describe(t):
    return rounded(rollup.describe(t.lineitem, "l_extendedprice", ["l_returnflag"]), "mean", "median", "p25", "p75", digits=4)


@query("""
SELECT o.o_orderkey, o.o_custkey, l.l_linenumber, l.l_quantity, e.n AS n_events
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON o.o_custkey = e.user_id""")
def j1_two_way_fanout(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    events = t.events.groupBy(F.col("user_id").alias("o_custkey")).agg(F.count(F.lit(1)).alias("n_events"))
    both = relational.join_features(t.orders.select("o_orderkey", "o_custkey"), lines, ["o_orderkey"], "_line")
    return relational.join_features(both, events, ["o_custkey"], "_event")


@query("""
SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1) o
ON c.c_custkey = o.o_custkey""")
def j2_left_dedup(t):
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    out = relational.left_join_first(t.customer.select("c_custkey", "c_name"), orders, ["c_custkey"], ["o_orderdate", "o_orderkey"], "_map")
    return out.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("""
SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN (
  SELECT doc_id, max(quality) FILTER (WHERE part = p) AS quality FROM (
    SELECT doc_id, quality, part, min(part) OVER (PARTITION BY doc_id) AS p FROM (
      SELECT doc_id, quality, 0 AS part FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, quality, 1 FROM labels)) GROUP BY doc_id) l USING (doc_id)""")
def j3_reward_join(t):
    parts = [t.labels.where("toxic = 0").select("doc_id", "quality"), t.labels.select("doc_id", "quality")]
    return t.documents.select("doc_id", "lang").join(relational.union_first(parts, ["doc_id"], [F.desc("quality")]), "doc_id", "left")


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, s.n FROM lineitem l LEFT JOIN (
  SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) s
ON l.l_orderkey = s.l_orderkey AND l.l_linenumber = s.l_linenumber""")
def j4_composite_left(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    n = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return lines.join(n, ["l_orderkey", "l_linenumber"], "left")


@query("""
SELECT d.doc_id, CASE WHEN d.lang IS NOT NULL AND trim(d.lang) <> '' AND d.doc_id % 3 <> 0 THEN d.lang ELSE b.lang END AS lang, b.extra
FROM documents d LEFT JOIN (SELECT doc_id, 'q' || quality AS lang, toxic AS extra FROM labels) b USING (doc_id)""")
def j5_backfill(t):
    left = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).otherwise(" ").alias("lang"))
    right = t.labels.select("doc_id", F.concat(F.lit("q"), "quality").alias("lang"), F.col("toxic").alias("extra"))
    return relational.backfill(left, right, ["doc_id"], ["lang", "extra"])


@query("""
SELECT l.l_orderkey, l.l_partkey, s.name_chars FROM lineitem l
LEFT JOIN (SELECT DISTINCT l_partkey, length(CAST(l_partkey AS VARCHAR)) AS name_chars FROM lineitem) s ON l.l_partkey = s.l_partkey""")
def j6_compute_once(t):
    lines = t.lineitem.select("l_orderkey", "l_partkey")
    return relational.compute_once(lines, ["l_partkey"], lambda d: d.withColumn("name_chars", F.length(F.col("l_partkey").cast("string")).cast("long")))


@query("""
SELECT c.c_custkey, c.c_mktsegment, o.n_runs FROM customer c JOIN (SELECT o_custkey, count(*) AS n_runs FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey""")
def j7_index_join(t):
    outcomes = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_runs"))
    return t.customer.select("c_custkey", "c_mktsegment").join(outcomes, "c_custkey")


@query("""
WITH a AS (SELECT l_suppkey AS k, round(avg(l_discount), 6) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
b AS (SELECT l_suppkey AS k, round(avg(l_discount), 6) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10 GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS k, a.v AS v_a, b.v AS v_b FROM a FULL JOIN b ON a.k = b.k),
r AS (SELECT *, CASE WHEN v_a IS NULL THEN NULL ELSE rank() OVER (ORDER BY v_a DESC NULLS LAST) + (count(*) OVER (PARTITION BY v_a) - 1) / 2.0 END AS rank_a,
  CASE WHEN v_b IS NULL THEN NULL ELSE rank() OVER (ORDER BY v_b DESC NULLS LAST) + (count(*) OVER (PARTITION BY v_b) - 1) / 2.0 END AS rank_b FROM j)
SELECT *, rank_a - rank_b AS rank_delta FROM r""")
def j8_full_outer_rank(t):
    # means at the middle of two rounded values are many, and a sum of doubles falls on either side of it by the order of its rows:
    # each supplier's discounts are added one by one in the order of the table, as the SQL does, however Spark splits it
    side = F.when(F.col("l_returnflag") == "A", "a").when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 10), "b")
    rows = t.lineitem.select(F.col("l_suppkey").alias("k"), side.alias("side"), "l_discount", F.struct("_metadata.file_path", "_metadata.row_index").alias("at")).where("side IS NOT NULL")
    upto = F.sum("l_discount").over(Window.partitionBy("k", "side").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    means = rows.withColumn("upto", upto).groupBy("k", "side").agg(F.try_divide(F.max_by("upto", "at"), F.count("l_discount")).alias("v"))
    path = tables.scratch(t.spark, "means")  # ranks read them several times
    rounded(means, "v").write.parquet(path)
    of = lambda name: t.spark.read.parquet(path).where(F.col("side") == name).select("k", "v")
    return ranking.consistency(of("a"), of("b"), "k", "v", ("a", "b"))


@query("SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def j9_lookup(t):
    names = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return relational.lookup(t.customer.select("c_custkey", "c_nationkey"), names, "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("""
WITH s AS (SELECT p_type, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1),
t AS (SELECT p_type, total, row_number() OVER (ORDER BY total DESC, p_type) AS rank FROM s),
k AS (SELECT * FROM t WHERE rank <= 8)
SELECT a.p_type AS p_type_a, a.total AS total_a, CAST(a.rank AS INTEGER) AS rank_a, b.p_type AS p_type_b, b.total AS total_b, CAST(b.rank AS INTEGER) AS rank_b
FROM k a JOIN k b ON a.rank < b.rank""")
def j16_topk_pairs(t):
    s = rounded(t.part.groupBy("p_type").agg(F.sum("p_retailprice").alias("total")), "total", digits=2)
    return relational.top_pairs(s, "p_type", "total", 8)


@query("""
SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def j17_anti(t):
    return relational.unmatched(t.documents, t.labels, ["doc_id"])


@query("""
SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'""")
def j18_overlap(t):
    return relational.overlap(t.orders.where("o_orderpriority = '1-URGENT'"), t.orders.where("o_orderpriority = '5-LOW'"), "o_custkey")


@query("""
WITH g AS (SELECT l_orderkey, l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2),
e AS (SELECT l_orderkey, c, sum(c) OVER (PARTITION BY l_orderkey) AS tot, count(*) OVER (PARTITION BY l_orderkey) AS n FROM g)
SELECT l_orderkey, round(max(CASE WHEN n > 1 THEN 1 ELSE 0 END) * sum(CASE WHEN c > 0 AND tot > 0 THEN -c / tot * log2(c / tot) ELSE 0 END), 6) AS entropy FROM e GROUP BY 1""")
def g14_churn_entropy(t):
    churn = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("c"))
    return rounded(rollup.entropy(churn, ["l_orderkey"], "c"), "entropy")


@query("""
WITH g AS (SELECT l_orderkey, l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY c) AS i FROM g),
s AS (SELECT l_orderkey, sum(i * c) AS s, sum(c) AS t, count(*) AS n FROM r GROUP BY 1)
SELECT l_orderkey, round(CASE WHEN n > 1 AND t > 0 THEN greatest(0.0, least(1.0, 2.0 * s / (n * t) - (n + 1.0) / n)) ELSE 0.0 END, 6) AS gini FROM s""")
def g15_churn_gini(t):
    churn = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("c"))
    return rounded(rollup.gini(churn, ["l_orderkey"], "c"), "gini")


@query("""
SELECT l_orderkey, l_partkey, c FROM (
  SELECT l_orderkey, l_partkey, c, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, l_partkey) AS r
  FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS c FROM lineitem GROUP BY 1, 2)) WHERE r = 1""")
def g16_primary_item(t):
    churn = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("c"))
    return rollup.largest(churn, ["l_orderkey"], "l_partkey", "c")


@query("""
WITH m AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2)
SELECT user_id, round(sum(CASE WHEN c > 1 THEN c - 1 ELSE 0 END) / sum(c), 6) AS reuse_ratio, round(avg(c), 6) AS chain_len_mean FROM m GROUP BY 1""")
def g19_mention_reuse(t):
    return rounded(rollup.reuse(t.events, ["user_id"], "event_type"), "reuse_ratio", "chain_len_mean")


@query("""
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, min(l_suppkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS s FROM lineitem),
g AS (SELECT l_orderkey, greatest(s - lag(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) AS gap,
  lag(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) IS NOT NULL AS has FROM d)
SELECT l_orderkey, round(coalesce(avg(gap) FILTER (WHERE has), 0.0), 6) AS gap_mean FROM g GROUP BY 1""")
def w4_gap_mean(t):
    hunks = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    return rounded(rollup.mean_gap(hunks, ["l_orderkey"], [], ["l_linenumber"], "s"), "gap_mean")


@query("SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, NULL FROM documents WHERE lang = 'en'")
def u1_union_all(t):
    return t.labels.select("doc_id", "quality").unionByName(t.documents.where("lang = 'en'").select("doc_id"), allowMissingColumns=True)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u2_union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT event_type, min(event_id) AS first_at FROM events GROUP BY 1")
def u3_ordered_distinct(t):
    return relational.ordered_distinct(t.events, "event_type", F.col("event_id"))


@query("""
SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS both_sides,
 (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) AS only_left""")
def u5_set_checks(t):
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    both = a.intersect(b).agg(F.count(F.lit(1)).alias("both_sides"))
    return both.crossJoin(a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left")))  # one row each


@query("SELECT doc_id, CAST(quality AS INTEGER) AS quality, CAST(toxic AS INTEGER) AS toxic FROM labels")
def p2_constant_columns(t):
    df = t.labels.withColumn("same", F.lit(1))
    return df.select("doc_id", *relational.varying(df, ["quality", "toxic", "same"])).withColumns({c: F.col(c).cast("int") for c in ("quality", "toxic")})


@query("SELECT o_orderkey FROM orders WHERE coalesce(TRY_CAST(o_orderpriority[1:1] AS DOUBLE), 0) <> 0 AND (o_orderstatus IS NULL OR o_orderstatus NOT IN ('P', 'F'))")
def p3_p4_filters(t):
    return t.orders.where(relational.flag_on(F.left("o_orderpriority", F.lit(1))) & relational.not_in(F.col("o_orderstatus"), ["P", "F"])).select("o_orderkey")


@query("SELECT page_id FROM pages WHERE url IS NOT NULL AND regexp_matches(url, '^https?://[a-z0-9.-]+/') AND length(url) >= 7")
def p5_regex_length(t):
    return t.pages.where(F.col("url").rlike("^https?://[a-z0-9.-]+/") & (F.length("url") >= 7)).select("page_id")


@query("""
SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 AND d.source IS NOT NULL AND trim(d.source) <> '' THEN trim(d.source) ELSE coalesce(nullif(trim(d.lang), ''), '') END AS found FROM documents d""")
def p6_first_text(t):
    blank = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit(" NaN "))
    return t.documents.select("doc_id", first_text(blank, F.col("lang")).alias("found"))


@query("""
WITH j AS (SELECT d.doc_id, l.quality, CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.n_chars END AS n FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, coalesce(CAST(quality AS DOUBLE), (SELECT median(quality) FROM j)) AS quality, coalesce(CAST(n AS DOUBLE), (SELECT median(n) FROM j)) AS n FROM j""")
def p8_median_fill(t):
    j = t.documents.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("n_chars")).alias("n")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return relational.median_fill(j, ["quality", "n"])


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def p9_default_fill(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality", "toxic").na.fill({"quality": 0, "toxic": 0})


@query("SELECT lang || '__' || doc_id AS row_uid, CASE WHEN n_chars > 0 THEN round(length(lang) / n_chars, 6) ELSE 0.0 END AS share, greatest(0, least(1, n_chars / 1000.0)) AS clipped FROM documents")
def p10_p13_p16_columns(t):
    clip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("n_chars") / F.lit(1000.0)))
    return t.documents.select(F.concat_ws("__", "lang", "doc_id").alias("row_uid"), F.round(ratio(F.length("lang"), F.col("n_chars")), 6).alias("share"), clip.cast("double").alias("clipped"))


@query("SELECT p_type, total FROM (SELECT p_type, round(sum(p_retailprice) - 20000, 2) AS total FROM part GROUP BY 1) ORDER BY abs(total) DESC, p_type LIMIT 20")
def t1_t2_top_by_size(t):
    s = rounded(t.part.groupBy("p_type").agg((F.sum("p_retailprice") - 20000).alias("total")), "total", digits=2)
    return ranking.top_by_size(s, "total", 20, "p_type")


@query("""
WITH n AS (SELECT CAST(ceil(count(*) / 7.0) AS BIGINT) AS size FROM customer),
r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT c_custkey FROM r, n WHERE i >= 2 * size AND i < least(3 * size, 2 * size + 10)""")
def t3_t8_shard(t):
    return relational.shard(t.customer.select("c_custkey"), ["c_custkey"], 2, 7, max_rows=10)


@query("""
SELECT doc_id, quality, CASE WHEN r <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)""")
def a1_split(t):
    return split.train_test(t.labels.select("doc_id", "quality"), "doc_id", "quality")


@query("""
SELECT source, count(*) AS n, CASE WHEN CAST('0x' || substr(md5(source || '42'), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split
FROM documents GROUP BY 1""")
def a2_group_split(t):
    return split.group_split(t.documents, "source").groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels""")
def a3_folds(t):
    return split.folds(t.labels, "doc_id", 5, within=["quality"]).select("doc_id", "fold")


@query("""
WITH g AS (SELECT source, (row_number() OVER (ORDER BY md5(source || '42'), source) - 1) % 4 AS fold FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, CAST(fold AS INTEGER) AS fold FROM documents JOIN g USING (source)""")
def a3_group_folds(t):
    return split.group_folds(t.documents.select("doc_id", "source"), "source", 4).select("doc_id", "fold")


@query("""
WITH m AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS sa, avg(p_retailprice) AS b, stddev_pop(p_retailprice) AS sb FROM part)
SELECT p_partkey, round((p_size - a) / sa, 6) AS p_size, round((p_retailprice - b) / sb, 6) AS p_retailprice FROM part, m""")
def a4_zscore(t):
    return rounded(vif.zscores(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]), "p_size", "p_retailprice")


@query("""
WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem),
d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM c)
SELECT 'l_quantity' AS feature, round((1 - bc * bc) / det, 4) AS vif FROM d UNION ALL
SELECT 'l_extendedprice', round((1 - ac * ac) / det, 4) FROM d UNION ALL SELECT 'l_discount', round((1 - ab * ab) / det, 4) FROM d""")
def a5_vif3(t):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    found = vif.factors(vif.correlations(t.lineitem, columns))
    return t.spark.createDataFrame([(c, round(float(v), 4)) for c, v in zip(columns, found)], "feature string, vif double")


@query("SELECT l_returnflag, round(avg(l_tax), 6) AS mean, round(stddev_pop(l_tax), 6) AS std FROM lineitem GROUP BY 1")
def g11_fold_summary(t):
    from ..operators.metrics import fold_summary

    return rounded(fold_summary(t.lineitem, "l_tax", ["l_returnflag"]), "mean", "std")


@query("SELECT doc_id, lang FROM documents")
def s1_load_split(t):
    return tables.load(t.spark, f"{t.dir}/documents.parquet", columns=["doc_id", "lang"])


@query("SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i = 7")
def s2_row_at(t):
    return tables.row_at(tables.with_row_index(t.documents.select("doc_id", "lang", "n_chars"), ["doc_id"]), 7).drop("row_index")


@query("SELECT source AS key, min(i) AS row_index FROM (SELECT source, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE source <> '' GROUP BY 1")
def s3_first_index(t):
    return tables.first_index(tables.with_row_index(t.documents.select("doc_id", "source"), ["doc_id"]), "source")


@query("SELECT d.doc_id, d.n_chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s6_subset(t):
    return tables.subset(t.documents, t.labels.where("toxic = 1"), "doc_id", ["doc_id", "n_chars"])


@query("SELECT doc_id, toxic FROM labels")
def s4_csv_round_trip(t):
    from ..sources.tables import scratch

    path = scratch(t.spark, "labels.csv")
    tables.write_csv(t.labels, path, ["doc_id", "toxic"])
    return tables.load(t.spark, path, schema="doc_id long, toxic int")


@query("SELECT CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR) AS row_json FROM nation")
def f38_rows_as_json(t):
    return relational.row_json(t.nation.select("n_nationkey", "n_name", "n_regionkey"))


@query("""
WITH m AS (SELECT avg(abs(l_discount)) AS d, avg(abs(l_tax * 0)) AS z FROM lineitem)
SELECT l_orderkey, l_partkey, l_discount FROM lineitem WHERE (SELECT z FROM m) = 0 AND (SELECT d FROM m) > 0""")
def a7_zero_importance(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_discount", (F.col("l_tax") * 0).alias("l_tax"))
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("phi")) for c in ("l_discount", "l_tax")))).alias("p")).select("p.*")
    return relational.without_zero_importance(rows, long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("phi")), "feature", "phi", keep=["l_orderkey", "l_partkey"])


@query("""
WITH e AS (SELECT l_shipmode AS feature, avg(l_quantity) - 25 AS size FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_quantity FROM lineitem) GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY abs(size) DESC, feature) AS place FROM e)
SELECT feature, round(size, 6) AS size, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3 AND feature IN ('AF', 'NO', 'RF', 'NF')""")
def a8_effect_preselection(t):
    effects = t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("feature")).agg((F.avg("l_quantity") - 25).alias("size"))
    return rounded(relational.preselected(effects, ["AF", "NO", "RF", "NF"], "feature", "size", 3), "size")


@query("SELECT l_suppkey, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ORDER BY 1, 2 LIMIT 500")
def t10_capped_pairs(t):
    return relational.capped_pairs(t.lineitem, "l_suppkey", "l_partkey", 500)


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS churn, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS present FROM lineitem GROUP BY 1),
r AS (SELECT o_custkey AS task, o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS ok, o_totalprice AS price, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_acctbal END AS balance,
  -o_totalprice AS other, n, churn, o_orderpriority AS split, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE c_mktsegment || (o_orderkey % 2) END AS repo
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN l ON l_orderkey = o_orderkey WHERE present <> 0 AND o_orderpriority <> '5-LOW'),
a AS (SELECT task, avg(ok) AS pass_rate, count(*) AS n_runs, CAST(sum(ok) AS BIGINT) AS n_success, arg_min(repo, k) FILTER (WHERE repo IS NOT NULL) AS base_repo FROM r GROUP BY 1),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY task ORDER BY k) = 1)
SELECT CAST(task AS VARCHAR) AS task_id, CAST(k AS VARCHAR) AS trajectory_id, split AS cf_split, k AS cf_row_index, base_repo, round(pass_rate, 6) AS pass_rate, n_runs, n_success,
 CAST(n_success >= 1 AS INTEGER) AS any_success, CAST(pass_rate >= 0.5 AS INTEGER) AS maj_success, round(price, 6) AS prompt_price, round(other, 6) AS prompt_price_repo,
 round(coalesce(balance, (SELECT median(balance) FROM f)), 6) AS repo_balance, CAST(n AS DOUBLE) AS patch_lines, round(churn, 6) AS patch_churn FROM f JOIN a USING (task)""")
def g1_task_table(t):
    """The task table as a whole: orders are runs of a customer's task, lines are the patch, priorities the splits."""
    key = F.col("o_orderkey").cast("string").alias("trajectory_id")
    task, reward = F.col("o_custkey").cast("string").alias("task_id"), F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "P", 0.5).alias("reward")
    prompt = t.orders.select(key, task, reward, F.col("o_totalprice").alias("prompt_price"), F.lit(1).alias("prompt_constant"))
    of = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    balance = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_acctbal")).alias("repo_balance")
    repo = of.select(key, balance, (-F.col("o_totalprice")).alias("prompt_price"), F.lit(None).cast("double").alias("repo_null"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("trajectory_id"))
    patch = lines.agg(F.count(F.lit(1)).alias("patch_lines"), F.sum("l_quantity").alias("patch_churn"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("patch_present"))
    name = F.when(F.col("o_orderkey") % 3 != 0, F.concat("c_mktsegment", (F.col("o_orderkey") % 2).cast("string"))).alias("base_repo")
    mapping = of.select(key, F.col("o_orderpriority").alias("cf_split"), F.col("o_orderkey").alias("cf_row_index"), name)
    mapping = mapping.unionByName(mapping.withColumns({"cf_split": F.lit("~"), "base_repo": F.lit("second")}))  # of rows of one id the first counts
    out = rollup.task_level(prompt, repo, patch, mapping, F.col("cf_row_index"), ["5-LOW"])
    return rounded(out, "pass_rate", "prompt_price", "prompt_price_repo", "repo_balance", "patch_churn")
