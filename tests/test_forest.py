"""Walks by pointer doubling against ``Parse`` on random forests, chains and odd rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.operators import forest, nlp


def random_tokens(seed):
    rng, rows = np.random.default_rng(seed), []
    deps = ["ROOT", "prep", "conj", "ccomp", "advcl", "amod", None]
    for doc in range(4):
        n = [40, 1, 300, 25][doc]
        for i in range(n):
            head = i if i == 0 or rng.random() < 0.05 else int(rng.integers(max(0, i - (2 if doc == 2 else 20)), i))
            rows.append((doc, i // 12, 10 * i, 10 * head, deps[rng.integers(0, 7)], "NOUN", bool(rng.random() < 0.1), False))
    return pd.DataFrame(rows, columns=["doc_id", "sent_id", "i", "head_i", "dep", "pos", "is_space", "is_punct"])


def test_token_walks_equal_the_parse(spark):
    data = random_tokens(1)
    got = forest.token_walks(spark.createDataFrame(data).repartition(3), nlp.CLAUSE).toPandas().sort_values(["doc_id", "i"])
    for doc, part in data.groupby("doc_id"):
        p, mine = nlp.Parse(part), got[got.doc_id == doc]
        top = np.arange(len(p.up))
        for t in p.order:
            if p.conj[t] and not p.root[t]:
                top[t] = top[p.up[t]]
        assert mine.depth.tolist() == p.depth.tolist() and mine.nesting.tolist() == p.nesting().tolist()
        assert mine.prep_run.tolist() == p.prep_runs().tolist() and mine.words_below.tolist() == p.subtrees().tolist()
        assert mine.chain.tolist() == p.i[top].tolist()


def test_long_chain_and_odd_rows(spark):
    rows = [("c", k, k - 1) for k in range(1000)] + [(None, 1, 1), (None, 2, 1), ("x", 5, None), ("x", 6, 99), ("x", 7, 6)]
    df = spark.createDataFrame(rows, "g string, n long, up long")
    got = {(r.g, r.n): (r.root, r.depth, r.twice) for r in forest.climb(df, ["g"], "n", F.col("up"), {"twice": F.lit(2)}).collect()}
    assert len(got) == len(rows)
    assert all(got["c", k] == (0, k, 2 * k) for k in range(1000))
    assert got[None, 2] == (1, 1, 2) and got["x", 5] == (5, 0, 0) and got["x", 6] == (6, 0, 0) and got["x", 7] == (6, 1, 2)
    below = {(r.g, r.n): r.s for r in forest.subtree_sums(df, ["g"], "n", F.col("up"), F.lit(1), "s").collect()}
    assert all(below["c", k] == 1000 - k for k in range(1000)) and below[None, 1] == 2 and below["x", 6] == 2
    assert forest.climb(df.limit(0), ["g"], "n", F.col("up")).count() == 0


def test_cycles_are_an_error(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "g int, n long, up long")
    with pytest.raises(ValueError, match="ancestor"):
        forest.climb(df, ["g"], "n", F.col("up"))
