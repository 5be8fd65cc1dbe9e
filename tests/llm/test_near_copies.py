import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import minhash as M
from gristmill.llm.components import components
from gristmill.llm.minhash import near_duplicates, one_per_class

from .helpers import DDL, clashing, empty, odd


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(70, 99)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes(100, links)
    assert got == {x: want[x] for p in links if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_samples_agree_with_the_similarity():
    rng = np.random.default_rng(5)
    h = np.sort(rng.integers(0, 1 << 63, 500, np.uint64))
    a = (h[:400], rng.random(400).astype(np.float32) + 0.5)
    b = (h[100:], np.concatenate([a[1][100:], rng.random(100).astype(np.float32) + 0.5]))
    s = M.Sampler(400, 1)
    assert abs((s.keys(*a) == s.keys(*b)).mean() - M.similarity(a, b)) < 0.08


def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    base, shared, docs = text(120), text(30), []
    for k in range(60):  # a chain of edits: neighbours alike, ends not
        base = list(base)
        base[rng.randrange(120)] = rng.choice(words)
        docs.append(" ".join(base))
    docs += [" ".join(text(60) + shared) for _ in range(40)]  # a passage in common
    one = " ".join(text(80))
    docs += [one, one.upper() + "!", one, "few words", "Few, words", "", None, "...", "x"]
    return docs


def test_near_copies_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(docs)], DDL)
    idf = M.word_frequencies(df.select("text"))
    vec = [M.shingles(M.word_hashes(t), idf) for t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if len(vec[i][0]) and len(vec[j][0]) and M.similarity(vec[i], vec[j]) >= 0.8]
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert [got[i] for i in range(len(docs))] == classes(len(docs), links)
    assert len(links) > 100 and any(M.similarity(vec[0], vec[k]) < 0.8 and got[k] == 0 for k in range(60))


@pytest.mark.parametrize("make", [odd, clashing])
def test_near_copies_of_odd_rows(spark, make):
    got = near_duplicates(make(spark)).collect()
    assert len(got) == 11 and [r.class_id for r in got if r.doc_id is None] == [None] and {r.class_id for r in got if r.doc_id == 2} == {2}
    kept = one_per_class(make(spark))
    assert kept.columns == make(spark).columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, {r.doc_id for r in odd(spark).collect()}))
    assert near_duplicates(empty(spark)).count() == 0 and one_per_class(empty(spark)).count() == 0


def test_one_row_of_each_class(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    df = spark.createDataFrame([(1, a, "", "", 0), (2, a, "", "", 0), (2, b, "", "", 0), (3, b, "", "", 0), (3, "", "", "", 0), (3, None, "", "", 0)], DDL)
    got = sorted((r.doc_id, r.text) for r in one_per_class(df).collect() if r.text)
    assert got == [(1, a), (2, b)]


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "packing"]
    path, docs, seen = None, documents, {}
    from gristmill.llm.common import new_path

    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "test-" + name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        assert name == "packing" or docs.columns == documents.columns
    before = {r.doc_id: r.text for r in documents.collect()}
    good = {r.doc_id: r.text for r in seen["quality"].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(before[i] == t for i, t in good.items())
    assert sum((i in good) == (q == 1) for i, q in labels.items()) / len(labels) > 0.9
    from .test_dedup import brute_lines

    assert {r.doc_id: r.text for r in seen["line_dedup"].collect()} == {i: t for i, t, *_ in brute_lines(list(good.items()))}
    lines = seen["line_dedup"].orderBy("doc_id").collect()
    idf = M.word_frequencies(seen["line_dedup"].select("text"))
    vec = [M.shingles(M.word_hashes(r.text), idf) for r in lines]
    links = [(i, j) for i in range(len(vec)) for j in range(i) if len(vec[i][0]) and len(vec[j][0]) and M.similarity(vec[i], vec[j]) >= 0.8]
    root = classes(len(vec), links)
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == {lines[x].doc_id for x in set(root)}
    words = lambda df: df.select(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))).first()[0]
    assert abs(words(seen["mixing"]) - words(seen["near_duplicates"])) < 0.05 * words(seen["near_duplicates"])
    assert {r.doc_id for r in seen["packing"].collect()} == {r.doc_id for r in seen["mixing"].collect()}


def test_run_of_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline
    from gristmill.llm.common import staged_now

    prose = [(100 + i, " ".join(f"word{i}x{k}" for k in range(120)), "en", "a" if i % 3 else None, 900) for i in range(40)]
    docs = odd(spark).unionByName(spark.createDataFrame([*prose, prose[0], (300, prose[1][1], "en", "b", 900)], DDL))
    docs = docs.withColumns({"h": F.lit("own"), "size": F.lit(1), "score": F.lit("x")})
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(40)] + [(4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for name, (d, marks) in {"full": (docs, labels), "bare": (docs, labels.limit(0)), "none": (docs.limit(0), labels)}.items():
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        before = staged_now(spark)
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        left = staged_now(spark) - before
        assert sum(x.startswith("mixing") for x in left) == 1 and not any(x.startswith(("quality", "line_dedup", "near_dup", "signatures")) for x in left)
        if name == "full":
            kept = {r.doc_id for r in pieces}
            assert len(kept & set(range(100, 140))) > 30 and 300 not in kept
        assert name != "none" or not pieces
