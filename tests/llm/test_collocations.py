"""Collocations against plain Python; automata against counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm.collocations import SuffixAutomaton, collocations, cut_words
from gristmill.llm.queries import op13_collocations

from .helpers import ODD, clashing, empty, odd

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    return [w for w in (re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER))) if w]


def brute(docs, least, top=2000):
    f = defaultdict(Counter)
    for lang, text in docs:
        for w in pieces(text):
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n, cand, rows = sum(v for p, v in c.items() if len(p) == 1), {p: v for p, v in c.items() if len(p) > 1 and v >= least}, []
        for p, a in cand.items():
            if any(100 * b >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for i, x in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in FIELDS) for r in df.collect())


def test_words_and_pieces():
    texts = ["Ab c. D", "", None, "x", "y\tz\n\n", "É,é . !", "tail", "head\x0bq \x1c\xa0"]
    words, opens, text = cut_words(pa.array(texts))
    got = defaultdict(list)
    for w, o, t in zip(words.to_pylist(), opens, text):
        got[t].append([w]) if o else got[t][-1].append(w)
    assert [got[i] for i in range(len(texts))] == [pieces(t) for t in texts]
    assert len(cut_words(pa.array(texts).slice(3, 2))[0]) == 3 and len(cut_words(pa.array([], pa.string()))[0]) == 0


@pytest.mark.parametrize("seed", range(4))
def test_automaton_counts_every_phrase(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(-1, 1 + 2**seed, 3000)
    barred = (lambda a, b: (a + b) % 3 != 0) if seed % 2 else None
    made = SuffixAutomaton(words, 4, barred)
    want = defaultdict(Counter)
    for i in range(len(words)):
        for k in range(1, 5):
            p = words[i : i + k]
            if len(p) == k and (p >= 0).all() and (barred is None or all(barred(a, b) for a, b in zip(p, p[1:]))):
                want[k][tuple(p.tolist())] += 1
    for k in range(1, 5):
        found, counts = made.phrases(k)
        assert Counter(dict(zip(map(tuple, found.tolist()), counts.tolist()))) == want[k]
    # a link leads to a shorter suffix that ends in more places; phrases of a state have its count
    assert (made.longest[made.link[1:]] < made.longest[1:]).all()
    inner = made.link[1:] > 0
    assert (made.count[made.link[1:]][inner] > made.count[1:][inner]).all()
    assert len(made.link) - 1 <= sum(map(len, made.state))


def test_empty_automaton():
    assert len(SuffixAutomaton(np.zeros(0, np.int64), 4).phrases(3)[1]) == 0
    assert len(SuffixAutomaton(np.full(5, -1), 2).phrases(1)[1]) == 0


@pytest.mark.parametrize("least", [3, 30])
def test_sf_table(spark, sf, least):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = {}
    if least == 3:
        docs, more = docs.where("doc_id % 5 = 0"), {"shard": 500, "bitmap_size": 16}  # a full bitmap keeps results right
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert found(collocations(docs.repartition(3), least=least, top=100, **more)) == brute(rows, least, 100)


def test_odd_rows(spark):
    want = brute([(r[2], r[1]) for r in ODD], 2)
    assert found(collocations(odd(spark), least=2)) == want
    assert found(collocations(clashing(spark).withColumnsRenamed({"key": "w1", "h": "f"}), least=2)) == want
    assert collocations(empty(spark)).count() == 0


def test_languages_and_ties(spark):
    rows = [("a", "x y z."), ("b", "x y"), (None, "x y"), ("und", "x y, x y"), ("a", "x y z, y x"), ("a", "y x. q y x q"), ("b", "X\tY  x y")]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(collocations(df, least=1)) == brute(rows, 1)


def test_query(spark, sf):
    got = op13_collocations(spark, sf)
    assert got.columns == FIELDS and {t for _, t in got.dtypes} == {"string", "bigint"}
