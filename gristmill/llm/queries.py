"""The queries ``opN_<name>`` over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode_ids, encode_texts
from .collocations import collocations
from .common import staged
from .linededup import dedup_lines
from .media import encode_media, media_features
from .minhash import near_duplicates
from .mixing import mix_counts
from .packing import pack_documents
from .quality import fit_quality, held_out, score_documents
from .sharding import grown, layout, shard_documents
from .spans import dedup_spans
from .tokenfile import tokens_on_disk
from .topk import top_products
from .trie import prefix_nodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_on_disk(spark, table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), layout(40), grown(layout(40), 40))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = staged(encode_media(table(spark, sf_dir, "documents").select("doc_id", "text"), kind=2), "media")
    return media_features(stored)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    out = score_documents(docs.select("doc_id", "text", "n_chars"), machine)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return decode_ids(coded).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND keyed.doc_id <> common.first_doc AS dropped
  FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP1_SQL = r"""
WITH units AS (
  SELECT doc_id, generate_subscripts(u, 1) AS pos, unnest(u) AS unit
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+[ \t\n\r]*|[^.!?\n]+') AS u FROM documents)),
plain AS (
  SELECT *, trim(regexp_replace(lower(unit), '[ \t\n\r]+', ' ', 'g'), ' ') AS s FROM units),
sized AS (SELECT *, len(string_split(s, ' ')) AS w FROM plain),
windows AS (
  SELECT a.doc_id, a.pos, b.pos - a.pos + 1 AS length, sum(b.w) OVER o AS words, string_agg(b.s, chr(10)) OVER o AS span
  FROM sized AS a JOIN sized AS b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 24
  WINDOW o AS (PARTITION BY a.doc_id, a.pos ORDER BY b.pos)),
spans AS (
  SELECT doc_id, pos, 1 AS length, s AS span FROM sized WHERE w >= 50
  UNION ALL
  SELECT doc_id, pos, length, span FROM windows WHERE length >= 2 AND words >= 25
  QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY length) = 1),
firsts AS (SELECT span, length, min(row(doc_id, pos)) AS f FROM spans GROUP BY span, length HAVING count(*) > 1),
hit AS (
  SELECT DISTINCT doc_id, pos + k AS pos
  FROM (SELECT spans.doc_id, spans.pos, spans.length FROM spans JOIN firsts ON spans.span = firsts.span AND spans.length = firsts.length
        WHERE row(spans.doc_id, spans.pos) <> firsts.f), (SELECT unnest(range(25)) AS k) WHERE k < length),
marked AS (
  SELECT units.*, hit.pos IS NOT NULL AS gone FROM units LEFT JOIN hit ON units.doc_id = hit.doc_id AND units.pos = hit.pos)
SELECT d.doc_id, count(m.pos) AS n_sentences, CAST(coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(unit, '' ORDER BY m.pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""

OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: CRC-32 byte by byte, its bits by the reflected polynomial.
OP12_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda acc, x: list_reduce(list_prepend(xor(acc, x), CAST(range(8) AS BIGINT[])), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
b AS (
  SELECT k.c, t.n, t.role, t.text FROM k JOIN t ON t.c = k.base AND t.n <= k.h
  UNION ALL SELECT k.c, t.n + 10, t.role, t.text FROM k JOIN t ON t.c = k.c AND t.n > k.h),
s AS (SELECT k.c, list((role, text) ORDER BY n) FILTER (WHERE n IS NOT NULL) AS turns FROM k LEFT JOIN b ON b.c = k.c GROUP BY k.c),
p AS (
  SELECT c, d, coalesce(turns, [])[1:d] AS node, len(coalesce(turns, [])) AS size, CASE WHEN d > 0 THEN turns[d][2] END AS text
  FROM (SELECT c, turns, unnest(range(coalesce(len(turns), 0) + 1)) AS d FROM s)),
g AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n, any_value(text) AS text, string_agg(CASE WHEN size = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends
  FROM p GROUP BY node, d),
kids AS (SELECT node[1:d - 1] AS node, count(*) AS kids FROM g WHERE d > 0 GROUP BY 1),
v AS (SELECT g.*, coalesce(kids, 0) AS kids, (n - 1) * len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+')) AS gain FROM g LEFT JOIN kids ON g.node = kids.node),
below AS (SELECT p.node, CAST(sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS BIGINT) AS leaves, CAST(sum(gain) AS BIGINT) AS saved FROM v JOIN p ON p.c = v.conv_id AND p.d <= v.d GROUP BY p.node)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, below.leaves AS n_leaves, below.saved AS saved_tokens,
       sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN below ON v.node = below.node LEFT JOIN g u ON v.d > 0 AND u.d = v.d - 1 AND u.node = v.node[1:v.d - 1]
"""

OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (
  SELECT lang, k AS size, ws[i:i + k - 1] AS ph, count(*) AS f FROM i, (SELECT unnest(range(1, 5)) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
c AS (SELECT * FROM f WHERE size >= 2 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (
  SELECT cuts.lang, cuts.size, cuts.ph, cuts.f AS a, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * cuts.f) // (l.f + r.f) AS score, k
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.ph = cuts.ph[1:k] JOIN f r ON r.lang = cuts.lang AND r.ph = cuts.ph[k + 1:cuts.size]
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.ph ORDER BY score, k) = 1),
sub AS (
  SELECT lang, ph[i:i + m - 1] AS ph, max(f) AS by FROM (SELECT lang, size, ph, f, unnest(range(1, size)) AS i FROM c), (SELECT unnest([2, 3]) AS m)
  WHERE m < size AND i + m - 1 <= size GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, array_to_string(s.ph, ' ')) AS rank, array_to_string(s.ph, ' ') AS phrase, a, l, r, n.n, CAST(score AS BIGINT) AS score
FROM s JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang) n ON n.lang = s.lang
LEFT JOIN sub ON sub.lang = s.lang AND sub.ph = s.ph WHERE sub.by IS NULL OR 100 * sub.by < 80 * a
QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_retrieval_packing, op3_token_files, op4_exact_top_k, op5_source_mix, op6_hash_tree_shards, op7_minhash_classes, op8_media_columns, op9_line_dedup, op10_quality_classifier,
        op11_byte_bpe, op12_prefix_trie, op13_collocations,
    )}  # fmt: skip


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op4_exact_top_k": OP4_SQL, "op9_line_dedup": OP9_SQL, "op12_prefix_trie": OP12_SQL, "op13_collocations": OP13_SQL}
