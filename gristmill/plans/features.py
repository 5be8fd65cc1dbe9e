"""Text, path, patch, tree, message and parse features: over the proxy tables, and over inline rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import ids, paths, text
from ..operators import behaviour, forest, nlp, patch, rollup, tree
from .registry import query, rounded

TREE = [("README", "blob", 10), ("docs/a.md", "blob", None), ("docs", "tree", None), ("src", "tree", None), ("src/app.py", "blob", 30), ("src/lib/app.py", "blob", 20), ("tests/test_app.py", "blob", 40)]
MESSAGES = json.dumps([
    {"role": "system", "content": "s"}, {"role": "user", "content": " first "}, {"role": "user", "content": "x <issue_description> the\nbug </issue_description> y"},
    {"role": "assistant", "content": [{"text": "open src/app.py"}, {"text": "and"}, {"n": 1}], "name": "open_file"}, {"role": "tool", "content": "pytest: 1 failed in src/lib/app.py", "tool_name": "Edit"},
    {"role": "tool", "content": "pytest ok, see src/app.py", "name": "x"},
])


@query("""
SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS ids_ascii, CAST(regexp_matches(text, '(?i)(Error|Exception|Traceback|failed|raises)') AS INTEGER) AS error,
 CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS lines,
 len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '^\\s*(?:[-*]|\\d+\\.)\\s+'))) AS bullets
FROM documents""")
def f22_text_counters(t):
    c = text.text_counters(F.col("text"))
    ascii_ids = F.regexp_count("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"))
    return t.documents.select("doc_id", c["prompt_char_count"].cast("long").alias("chars"), ascii_ids.cast("long").alias("ids_ascii"), c["prompt_has_error_keyword"].alias("error"), c["prompt_line_count"].cast("long").alias("lines"), c["prompt_bullet_count"].cast("long").alias("bullets"))


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)
SELECT page_id, CAST(length(p) - length(replace(p, '/', '')) AS INTEGER) AS depth, string_split(trim(p, '/'), '/')[1] AS first_segment,
 lower(regexp_extract(string_split(rtrim(p, '/'), '/')[-1], '[^.]\\.([^.]+)$', 1)) AS ext,
 CAST(string_split(rtrim(p, '/'), '/')[-1] LIKE 'test\\_%' ESCAPE '\\' OR contains(p, '/tests/') AS INTEGER) AS is_test FROM p""")
def f26_url_paths(t):
    p = F.col("p")
    rows = t.pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("p"))
    return rows.select("page_id", paths.depth(p).cast("int").alias("depth"), paths.first_segment(p).alias("first_segment"), paths.extension(p).alias("ext"), paths.is_test(p).cast("int").alias("is_test"))


@query("""
WITH p AS (SELECT string_split(regexp_replace(url, '^https?://', ''), '/')[1] AS host, string_split(rtrim(url, '/'), '/')[-1] AS name FROM pages),
n AS (SELECT host, name, count(*) AS n FROM p GROUP BY 1, 2) SELECT host, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS collisions FROM n GROUP BY 1""")
def g12_basename_collisions(t):
    rows = t.pages.select(paths.first_segment(F.regexp_replace("url", "^https?://", "")).alias("host"), paths.basename(F.col("url")).alias("name"))
    return rollup.collisions(rows, ["host"], "name")


@query("""
WITH p AS (SELECT regexp_replace(url, '^https?://', '') AS p FROM pages)
SELECT CASE WHEN contains(p, '/') THEN regexp_replace(p, '/+[^/]*$', '') ELSE '.' END AS parent, count(*) AS n FROM p GROUP BY 1""")
def g13_dir_counts(t):
    p = F.regexp_replace("url", "^https?://", "")
    return t.pages.groupBy(paths.parent(p).alias("parent")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a FROM documents),
b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS b FROM benchmark)
SELECT doc_id, item_id, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS overlap
FROM d JOIN b ON d.doc_id = b.item_id""")
def f28_u4_token_jaccard(t):
    a = t.documents.select("doc_id", text.word_tokens(F.col("text")).alias("a"))
    b = t.benchmark.select("item_id", text.word_tokens(F.col("text")).alias("b"))
    return rounded(a.join(b, F.col("doc_id") == F.col("item_id")).select("doc_id", "item_id", text.jaccard(F.col("a"), F.col("b")).alias("overlap")), "overlap")


@query("SELECT conv_id, trim(arg_min(text, turn) FILTER (WHERE role = 'user')) AS first_user FROM conversations GROUP BY 1")
def f20_first_user_message(t):
    return t.conversations.groupBy("conv_id").agg(text.py_strip(F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))).alias("first_user"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, CAST(sum(CASE WHEN contains(lower(text), 'process_control') THEN 1 ELSE 0 END) AS BIGINT) AS control, arg_min(CASE WHEN regexp_matches(lower(text), 'passed|ok') THEN 1 ELSE 0 END, i)
 FILTER (WHERE regexp_matches(lower(text), 'pytest|unittest') AND regexp_matches(lower(text), 'passed|ok|failed|traceback|error')) AS first_test FROM r GROUP BY 1""")
def f29_turn_behaviour(t):
    out = behaviour.behaviour(t.conversations.withColumns({"tool": F.lit(""), "primary": F.lit("a/b.py")}), "conv_id", "turn", "text", "tool", "primary")
    return out.select("conv_id", F.col("traj_process_control_frequency").alias("control"), F.col("traj_first_test_run_success").alias("first_test"))


@query("SELECT replace(replace(source, '/', '__'), ':', '__') AS safe, replace(source, '/', '__') || '__abc1234.json.gz' AS file FROM (SELECT DISTINCT source || '/' || lang AS source FROM documents)")
def f16_f17_names(t):
    s = F.concat_ws("/", "source", "lang")
    return t.documents.select(s.alias("s")).distinct().select(text.safe_name(F.col("s")).alias("safe"), ids.tree_file(F.col("s"), F.lit("abc1234")).alias("file"))


TREE_TYPE = "id long, tree array<struct<path: string, type: string, size: bigint>>, truncated boolean, changed_files array<string>, prompt string"


@query("""SELECT 1::BIGINT AS id, round(2.0 / 7, 6) AS prompt_patch_filename_token_overlap, round(2.0 / 12, 6) AS prompt_tree_filename_token_overlap, 2 AS prompt_patch_identifier_overlap_count,
 3 AS prompt_tree_candidate_file_count, 3 AS prompt_tree_candidate_dir_count, 1 AS changed_file_candidate_rank_min""")
def f28_t9_linking(t):
    rows = [(1, TREE, True, ["src/app.py", "lost/x.py"], "the app in src")]
    df = t.spark.createDataFrame(rows, TREE_TYPE).withColumn("blob_paths", tree.blob_paths(F.col("tree")))
    out = tree.linking_features(df, "prompt").drop("tree", "truncated", "changed_files", "prompt", "blob_paths")
    return rounded(out, "prompt_patch_filename_token_overlap", "prompt_tree_filename_token_overlap")


@query("SELECT 1 AS id, 0 AS traj_first_test_run_success, 1 AS traj_files_opened_before_first_edit, 0::BIGINT AS traj_process_control_frequency, 5 AS traj_time_to_first_correct_file_index, 2::BIGINT AS traj_touches_before_first_correct_file, 1::BIGINT AS traj_repeated_edits_same_file_count")
def f29_behaviour(t):
    rows = t.spark.createDataFrame([(1, MESSAGES.replace("open src/app.py", "open lib/z.py").replace("src/lib/app.py", "lib/z.py"), "src/app.py")], "id int, m string, main string")
    rows = rows.select("id", "main", F.posexplode(behaviour.messages(F.col("m"))).alias("k", "x"))
    out = behaviour.behaviour(rows.select("id", "k", F.col("x")["text"].alias("text"), F.col("x")["name"].alias("tool"), "main"), "id", "k", "text", "tool", "main")
    return out


TOKENS = [
    # doc, sent, i, head, dep, pos, lemma
    (1, 0, 0, 1, "nsubj", "PRON", "we"), (1, 0, 1, 1, "ROOT", "VERB", "fix"), (1, 0, 2, 3, "amod", "ADJ", "old"), (1, 0, 3, 1, "dobj", "NOUN", "bug"), (1, 0, 4, 3, "cc", "CCONJ", "and"),
    (1, 0, 5, 3, "conj", "NOUN", "leak"), (1, 0, 6, 5, "prep", "ADP", "in"), (1, 0, 7, 6, "pobj", "NOUN", "code"), (1, 0, 8, 1, "advcl", "VERB", "run"), (1, 0, 9, 8, "xcomp", "VERB", "test"), (1, 0, 10, 1, "punct", "PUNCT", "."),
    (1, 1, 11, 12, "nsubj", "PRON", "it"), (1, 1, 12, 12, "ROOT", "VERB", "fix"), (1, 1, 13, 12, "dobj", "NOUN", "bug"), (1, 1, 14, 12, "punct", "PUNCT", "."),
]


def tokens(t):
    rows = [(d, s, i, h, dep, pos, lemma, lemma, False, pos == "PUNCT", pos in ("PRON", "ADP", "CCONJ"), pos != "PUNCT") for d, s, i, h, dep, pos, lemma in TOKENS]
    return t.spark.createDataFrame(rows, "doc_id long, sent_id int, i int, head_i int, dep string, pos string, lemma string, text string, is_space boolean, is_punct boolean, is_stop boolean, is_alpha boolean")


@query("""SELECT 1::BIGINT AS doc_id, 2.0 AS prompt_sent_count, 2.0 AS prompt_clauses_per_sentence, 6.5 AS prompt_content_tokens_per_sentence, 4.5 AS prompt_clause_length_mean, 2.5 AS prompt_dep_depth_mean,
 round(30.0 / 13, 6) AS prompt_dep_distance_mean, 9.0 AS prompt_dep_distance_max, round(13.0 / 6, 6) AS prompt_branching_factor_mean, 0.25 AS prompt_clause_nesting_depth_mean, 2.0 AS prompt_max_conj_chain_len,
 1.0 AS prompt_noun_coordination_ratio, 0.25 AS prompt_attachment_competition_ratio, 0.0 AS prompt_pronoun_candidate_antecedent_density""")
def f32_f34_prompt_metrics(t):
    out = nlp.document_metrics(tokens(t))
    names = ["prompt_sent_count", "prompt_clauses_per_sentence", "prompt_content_tokens_per_sentence", "prompt_clause_length_mean", "prompt_dep_depth_mean", "prompt_dep_distance_mean", "prompt_dep_distance_max", "prompt_branching_factor_mean", "prompt_clause_nesting_depth_mean", "prompt_max_conj_chain_len", "prompt_noun_coordination_ratio", "prompt_attachment_competition_ratio", "prompt_pronoun_candidate_antecedent_density"]
    return rounded(out.select("doc_id", *names), *names)


@query("""SELECT 1::BIGINT AS doc_id, 15.0 AS prompt_parse_num_tokens, 1.25 AS prompt_parse_mean_clause_nesting_depth, round(1.0 / 4, 6) AS prompt_parse_modifiers_per_noun,
 round((-(3.0/11*ln(3.0/11) + 1.0/11*ln(1.0/11)*2 + 2.0/11*ln(2.0/11) + 4.0/11*ln(4.0/11)) + -(1.0/4*ln(1.0/4) + 3.0/4*ln(3.0/4))) / 2, 6) AS prompt_parse_mean_dep_entropy_per_sentence""")
def f33_g17_parse_metrics(t):
    names = ["prompt_parse_num_tokens", "prompt_parse_mean_clause_nesting_depth", "prompt_parse_modifiers_per_noun", "prompt_parse_mean_dep_entropy_per_sentence"]
    return rounded(nlp.document_metrics(tokens(t), "parse").select("doc_id", *names), *names)


@query("SELECT 1::BIGINT AS doc_id, round(2.0 / 7, 6) AS prompt_adjacent_lemma_overlap_mean, round(2.0 / 7, 6) AS prompt_adjacent_lemma_overlap_min")
def f31_w3_lemma_overlap(t):
    return rounded(nlp.lemma_overlaps(tokens(t)), "prompt_adjacent_lemma_overlap_mean", "prompt_adjacent_lemma_overlap_min")


@query("""
WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]+|[^.!?\\n]+')) AS s FROM documents) SELECT doc_id, CAST(count(*) AS DOUBLE) AS n FROM s WHERE regexp_matches(s, '[^\\s]') GROUP BY 1""")
def f32_sentences_of_documents(t):
    return nlp.document_metrics(nlp.plain_tokens(t.documents)).select("doc_id", F.col("prompt_sent_count").alias("n"))


@query()
def f23_token_count(t):
    import public_tokenizers

    count = text.token_count(text.byte_pairs(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    return t.documents.select("doc_id", count("text").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f15_json_field(t):
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query(r"""
WITH RECURSIVE s AS (SELECT doc_id, generate_subscripts(p, 1) AS sent, unnest(p) AS piece FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+') AS p FROM documents)),
w AS (SELECT doc_id, sent, generate_subscripts(x, 1) - 1 AS k, length(unnest(x)) AS size FROM (SELECT doc_id, sent, regexp_extract_all(piece, '[^ \t]+') AS x FROM s)),
t AS (SELECT doc_id, sent, k, size, CASE WHEN k = 0 THEN 0 ELSE greatest(0, (k - 1) // 2 - size % 2) END AS head FROM w),
a AS (
  SELECT doc_id, sent, k, head AS up FROM t WHERE k > 0
  UNION ALL SELECT a.doc_id, a.sent, a.k, t.head FROM a JOIN t ON t.doc_id = a.doc_id AND t.sent = a.sent AND t.k = a.up WHERE a.up > 0),
d AS (SELECT t.doc_id, count(a.up) AS depth, count(CASE WHEN a.up > 0 AND u.size > 5 THEN 1 END) AS long_above FROM t LEFT JOIN a ON a.doc_id = t.doc_id AND a.sent = t.sent AND a.k = t.k
  LEFT JOIN t u ON u.doc_id = a.doc_id AND u.sent = a.sent AND u.k = a.up GROUP BY t.doc_id, t.sent, t.k),
b AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, sent, k FROM t UNION ALL SELECT doc_id, sent, up FROM a) GROUP BY doc_id, sent, k) GROUP BY 1)
SELECT d.doc_id, max(depth) AS deepest, CAST(sum(depth) AS BIGINT) AS depths, CAST(sum(long_above) AS BIGINT) AS long_above, any_value(b.most) AS most FROM d JOIN b ON b.doc_id = d.doc_id GROUP BY 1""")
def f34_f35_ancestor_walks(t):
    pieces = t.documents.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^.!?\n]+"), F.lit(0))).alias("sent", "piece"))
    words = pieces.select("doc_id", "sent", F.posexplode(F.regexp_extract_all("piece", F.lit(r"[^ \t]+"), F.lit(0))).alias("k", "word"))
    size, k = F.length("word"), F.col("k")
    tokens = words.select("doc_id", "sent", "k", size.alias("size"), F.when(k == 0, 0).otherwise(F.greatest(F.lit(0), F.floor((k - 1) / 2).cast("int") - size % 2)).alias("head"))
    above = forest.climb(tokens, ["doc_id", "sent"], "k", F.col("head"), {"long_above": ((F.col("size") > 5) & (F.col("k") > 0)).cast("long")})
    below = forest.subtree_sums(tokens, ["doc_id", "sent"], "k", F.col("head"), F.lit(1).cast("long"), "n").groupBy("doc_id").agg(F.max("n").alias("most"))
    return above.groupBy("doc_id").agg(F.max("depth").alias("deepest"), F.sum("depth").alias("depths"), F.sum("long_above").alias("long_above")).join(below, "doc_id")


@query(r"""
WITH s AS (SELECT doc_id, generate_subscripts(p, 1) AS sent, unnest(p) AS piece FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+') AS p FROM documents)),
w AS (SELECT doc_id, sent, len(x) AS n, generate_subscripts(x, 1) AS k, unnest(x) AS word FROM (SELECT doc_id, sent, regexp_extract_all(piece, '[^ \t]+') AS x FROM s)),
t AS (SELECT *, length(word) AS size, length(word) % 3 <> 0 AND k < n AS inner_link, regexp_full_match(word, '[A-Za-z]+') AS alpha FROM w),
o AS (SELECT *, min(CASE WHEN NOT inner_link THEN k END) OVER (PARTITION BY doc_id, sent ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS root FROM t),
m AS (SELECT doc_id, sent, root, count(*) AS words, max(CASE WHEN k = root THEN size END) AS size, coalesce(string_agg(lower(word), ' ' ORDER BY k) FILTER (WHERE alpha AND size > 3), string_agg(lower(word), ' ' ORDER BY k) FILTER (WHERE alpha), '') AS key
  FROM o GROUP BY 1, 2, 3),
c AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(words) AS BIGINT) AS n_words FROM m WHERE size % 5 <> 0 GROUP BY 1),
u AS (SELECT doc_id, key, count(*) AS c FROM m WHERE size % 5 <> 0 AND size % 7 <> 0 AND key <> '' GROUP BY 1, 2),
r AS (SELECT doc_id, round(sum(c - 1) / sum(c), 6) AS reuse, round(avg(c), 6) AS chain, arg_max(key, (c, key)) AS most FROM u GROUP BY 1)
SELECT c.doc_id, n_spans, n_words, reuse, chain, most FROM c LEFT JOIN r ON r.doc_id = c.doc_id""")
def g19_f31_mentions(t):
    """Words that modify the next one by their lengths, and what they modify, as noun chunks; their keys by document."""
    found = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))

    def token(sent, n, word, k):
        size, i = F.length(word), sent.cast("long") * F.lit(1 << 32) + k
        link = (size % 3 != 0) & (k < n - 1)
        pos = F.when(size % 5 == 0, "VERB").when(size % 7 == 0, "PRON").otherwise("NOUN")
        return nlp.mention_token(i, F.when(link, i + 1).otherwise(i), F.when(link, "amod").otherwise("ROOT"), pos, word, word, word.rlike(r"^[A-Za-z]+\z"), size <= 3)

    sentence = lambda x, sent: F.transform(x, lambda word, k: token(sent, F.size(x), word, k))
    words = F.transform(found(F.coalesce("text", F.lit("")), r"[^.!?\n]+"), lambda piece: found(piece, r"[^ \t]+"))
    # a text is one row until its spans are found, so only counts by key are shuffled
    spans = nlp.mentions_of(t.documents.select("doc_id", F.flatten(F.transform(words, sentence)).alias("tokens")))
    out = nlp.mention_summary(spans).select("doc_id", "n_spans", "n_words", F.col("prompt_entity_reuse_ratio").alias("reuse"), F.col("prompt_coref_chain_len_mean").alias("chain"), "most")
    return rounded(out, "reuse", "chain")
