import hashlib
import random
import re

import pytest

from gristmill.llm.linededup import dedup_lines
from gristmill.llm.spans import dedup_spans

from .helpers import DDL, clashing, empty, odd, rows

WHITE = " \t\n\x0b\x0c\r"


def brute_lines(docs, least=2, chars=10):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(WHITE))
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        keep = [s for s in lines if i is None or len(key(s)) < chars or len(holders[key(s)]) < least or i == min(holders[key(s)])]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"common line number {k}" for k in range(12)] + ["short", "", "  ", "  Common Line number 3\t", "ÉCOLE line of text"]
    docs = [(i, "\n".join(rng.choice([*pool, f"own line of {i}"]) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DDL)
    want = sorted(brute_lines(docs))
    assert rows(dedup_lines(df), "doc_id", "text", "n_lines", "n_dropped") == want
    assert rows(dedup_lines(df, min_docs=5), "doc_id", "text", "n_lines", "n_dropped") == sorted(brute_lines(docs, 5))


def test_lines_odd_rows(spark):
    got = dedup_lines(odd(spark))
    want = brute_lines([(r.doc_id, r.text) for r in odd(spark).collect()])
    assert sorted(map(repr, rows(got, "doc_id", "text", "n_lines", "n_dropped"))) == sorted(map(repr, want))
    assert dedup_lines(empty(spark)).count() == 0


def test_lines_keep_other_columns(spark):
    got = dedup_lines(clashing(spark))
    assert got.columns.count("n_lines") == 1 and {"key", "h", "id"} <= set(got.columns)
    assert {r.key for r in got.collect()} == {"own key"}


def test_passage_of_fifty_words_goes_from_the_second_document(spark):
    passage = " ".join(f"w{i}" for i in range(30)) + ". " + " ".join(f"v{i}" for i in range(30)) + ". "
    df = spark.createDataFrame([(1, "One own start. " + passage + "End one.", "", "", 0), (2, "Two begins so. " + passage.upper() + "End two.", "", "", 0), (3, "Clean and alone.", "", "", 0)], DDL)
    got = {r.doc_id: r for r in dedup_spans(df).collect()}
    assert got[1].n_removed == 0 and got[2].text == "Two begins so. End two." and got[3].text == "Clean and alone."


SHORT = "".join(" ".join(f"s{i}w{k}" for k in range(5)) + (". ", "!! ", "\n")[i % 3] for i in range(12))


def test_passage_of_sixty_words_in_short_sentences_goes_from_the_second_document(spark):
    docs = [(1, "One own start. " + SHORT + "End one."), (2, "Two begins so. " + SHORT.upper() + "End two."), (3, "Three is. " + SHORT[: len(SHORT) // 5])]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in docs], DDL)
    got = {r.doc_id: r for r in dedup_spans(df).collect()}
    assert got[1].n_removed == 0 and got[1].text == docs[0][1] and got[3].n_removed == 0
    assert got[2].text == "Two begins so. End two." and got[2].n_removed == 12


def brute_grown(docs, n=2, least=25, single=50):
    parts = {k: re.findall(r"[^.!?\n]*[.!?\n]+[ \t\n\r]*|[^.!?\n]+", t or "") for k, t in docs.items()}
    plain = {k: [re.sub(r"[ \t\n\r]+", " ", s.lower()).strip(" ") for s in p] for k, p in parts.items()}
    words = lambda run: sum(len(s.split(" ")) for s in run)
    first, gone = set(), {k: set() for k in docs}
    for k in sorted(docs):
        for i in range(len(plain[k])):
            length = n
            while i + length < len(plain[k]) and words(plain[k][i : i + length]) < least:
                length += 1
            for size, enough in ((length, least), (1, single)):
                run = plain[k][i : i + size]
                if len(run) == size and words(run) >= enough:
                    if (size, tuple(run)) in first:
                        gone[k] |= set(range(i, i + size))
                    first.add((size, tuple(run)))
    return sorted((k, "".join(s for i, s in enumerate(p) if i not in gone[k]), len(p), len(gone[k])) for k, p in parts.items())


def test_grown_runs_against_brute_force(spark):
    rng = random.Random(6)
    sentence = lambda most: " ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.randrange(0, most))) + rng.choice([". ", "!! ", ".\n", "\n"])
    passages = ["".join(sentence(most) for _ in range(9)) for most in (3, 5, 8, 20, 40)]
    docs = {i: "".join(rng.choice(passages) if rng.random() < 0.3 else sentence(12) for _ in range(8)) for i in range(40)}
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs.items()], DDL)
    got = rows(dedup_spans(df), "doc_id", "text", "n_sentences", "n_removed")
    assert got == brute_grown(docs) and sum(r[3] for r in got) > 100


def test_grown_query_against_its_sql(spark, sf):
    import duckdb

    from gristmill.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(oracle_sql()["op1_substring_dedup"]).fetchall())
    assert rows(queries()["op1_substring_dedup"](spark, sf)) == want


def test_spans_odd_rows(spark):
    got = {(r.doc_id, r.text) for r in dedup_spans(clashing(spark)).collect()}
    assert (3, "") in got and (None, "shared line of text") in got and dedup_spans(empty(spark)).count() == 0
    texts = {r.doc_id: r.text for r in odd(spark).collect()}
    want = brute_grown({i: t for i, t in texts.items() if i is not None})
    assert rows(dedup_spans(odd(spark)).where("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id", "text", "n_sentences", "n_removed") == want


def test_very_long_texts_take_linear_time(spark):
    import time

    long = "\n".join(f"line {i} of a very long text" for i in range(30_000))
    df = spark.createDataFrame([(1, long, "", "", 0), (2, long, "", "", 0)], DDL)
    began = time.time()
    assert {(r.doc_id, r.n_removed) for r in dedup_spans(df).collect()} == {(1, 0), (2, 30_000)}
    assert {(r.doc_id, r.n_dropped) for r in dedup_lines(df).collect()} == {(1, 0), (2, 30_000)}
    assert time.time() - began < 60


@pytest.mark.parametrize("text", [None, "", "a\nb"])
def test_digest_of_lines(spark, text):
    df = spark.createDataFrame([(1, text, None, None, None)], DDL)
    assert hashlib.sha256(dedup_lines(df).first().text.encode()).hexdigest() == hashlib.sha256((text or "").encode()).hexdigest()
