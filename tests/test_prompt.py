"""Mention spans and the 33 prompt metrics on hand-made parses, token counts against the library."""

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import nlp

KIND = "doc_id long, sent_id int, i int, head_i int, dep string, pos string, lemma string, text string, is_space boolean, is_punct boolean, is_stop boolean, is_alpha boolean"


def parse(spark, words):
    """Rows (doc, sent, i, head, dep, pos, lemma, text)."""
    rows = [(*w, w[5] == "SPACE", w[5] == "PUNCT", w[6] in ("the", "it"), w[7].isalpha()) for w in words]
    return spark.createDataFrame(rows, KIND)


SAID = [
    (1, 0, 0, 2, "det", "DET", "the", "The"), (1, 0, 1, 2, "amod", "ADJ", "old", "old"), (1, 0, 2, 3, "nsubj", "NOUN", "parser", "parsers"), (1, 0, 3, 3, "ROOT", "VERB", "fail", "fail"),
    (1, 0, 4, 6, "amod", "ADJ", "old", "Old"), (1, 0, 5, 5, "", "SPACE", " ", " "), (1, 0, 6, 3, "dobj", "NOUN", "parser", "parser"), (1, 0, 7, 3, "punct", "PUNCT", ".", "."),
    (1, 1, 8, 9, "nsubj", "PRON", "it", "It"), (1, 1, 9, 9, "ROOT", "VERB", "drop", "drops"), (1, 1, 10, 12, "compound", "NOUN", "old", "old"), (1, 1, 11, 12, "nummod", "NUM", "7", "7"),
    (1, 1, 12, 9, "dobj", "NOUN", "parser", "parser"), (1, 1, 13, 9, "dobj", "PROPN", "the", "The"),
    (2, 0, 0, 0, "ROOT", "NOUN", "x1", "x1"),
]


def test_spans_and_keys(spark):
    tokens = parse(spark, SAID)
    got = sorted(tuple(r) for r in nlp.mention_spans(tokens).collect())
    assert got == [
        (1, 0, 3, "NOUN", "old parser"), (1, 6, 7, "NOUN", "parser"), (1, 8, 9, "PRON", "it"), (1, 10, 13, "NOUN", "old parser"), (1, 13, 14, "PROPN", "the"), (2, 0, 1, "NOUN", ""),
    ]
    entities = spark.createDataFrame([(1, 1, 4), (1, 0, 3), (1, 1, 4)], "doc_id long, start int, end int")
    more = {tuple(r) for r in nlp.mention_spans(tokens, entities).collect()}
    assert more == {*got, (1, 1, 4, "VERB", "old parser fail")}
    reuse = nlp.mention_reuse(nlp.mention_spans(tokens)).collect()
    assert [tuple(r) for r in reuse] == [(1, 0.25, 4 / 3)]
    assert nlp.mention_spans(tokens.limit(0)).count() == 0


def test_the_table_of_33(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "  \n"), (4, None), (5, "said but not parsed")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 1.0])], "doc_id long, sent_id int, vector array<float>")
    count = text.token_count(lambda: str.split)
    out = nlp.prompt_features(docs, parse(spark, SAID), count, vectors)
    assert out.columns == ["doc_id", *nlp.prompt_names()] and len(nlp.prompt_names()) == 33
    got = {r.doc_id: r.asDict() for r in out.collect()}
    assert set(got) == {1, 2, 3, 4, 5} and all(isinstance(v, float) for r in got.values() for n, v in r.items() if n != "doc_id")
    one = got[1]
    assert (one["prompt_len_bpe"], one["prompt_sent_count"], one["prompt_entity_reuse_ratio"]) == (2.0, 2.0, 0.25)
    assert one["prompt_adjacent_lemma_overlap_mean"] == pytest.approx(2 / 5) and one["prompt_sentence_embedding_sim_min"] == pytest.approx(0.5**0.5)
    assert one["prompt_clauses_per_sentence"] == 1.0 and one["prompt_dep_depth_mean"] == 2.0 and one["prompt_pronoun_ratio"] == 1 / 12
    assert got[2]["prompt_sent_count"] == 1.0 and got[2]["prompt_coref_chain_len_mean"] == 0.0
    assert all(v == 0 for d in (3, 4) for n, v in got[d].items() if n != "doc_id")
    assert got[5]["prompt_len_bpe"] == 4.0 and got[5]["prompt_sent_count"] == 0.0


def test_token_counts_are_the_library_s(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = ["", None, "a", "Straße und Füße, naïve 漢字 😀", "x" * 5000, "<|endoftext|> is text", " \n\t "]
    import base64

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", text.token_count(text.byte_pairs(path, pattern))(F.col("t")).alias("n")).collect()}
    assert got == {i: len(own.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
