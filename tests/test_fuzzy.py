"""The filtered fuzzy join against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import matching

WORDS = "alpha beta gamma delta omega parser loader widget engine socket Straße kernel buffer".split()


def texts(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice(WORDS)}-{rng.choice(WORDS)}__{rng.choice(WORDS)}-{rng.choice(WORDS)}-{rng.randrange(10**6)}" for _ in range(n)]


def edited(text, rng):
    for _ in range(rng.randrange(3)):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "x", "Z", text[at].upper()]) + text[at + rng.randrange(2) :]
    return text


def best(query, base, least):
    top, found = least, None
    for i, c in base:
        m = difflib.SequenceMatcher(a=query.casefold(), b=c.casefold())
        if m.real_quick_ratio() > top and m.quick_ratio() > top and m.ratio() > top:
            top, found = m.ratio(), i
    return found


def test_one_large_block(spark):
    rng, base = random.Random(5), texts(10_000, 1)
    asked = [edited(rng.choice(base), rng) for _ in range(40)] + texts(10, 2)
    left = spark.createDataFrame(list(enumerate(asked)), "id long, t string")
    right = spark.createDataFrame(list(enumerate(base)), "row_index long, t string")
    got = {r.id: r.row_index for r in matching.fuzzy(left, "id", F.col("t"), F.lit("b"), right, F.col("t"), F.lit("b")).collect()}
    want = {i: best(t, list(enumerate(base)), 0.97) for i, t in enumerate(asked)}
    assert got == {i: w for i, w in want.items() if w is not None} and len(got) > 20
    blocks = (d.select(F.lit("b").alias("block"), F.col("t").alias("text")) for d in (left, right))
    assert matching.near_texts(*blocks).count() < 0.01 * len(asked) * len(base)


@pytest.mark.parametrize("least", [0.97, 0.9, 0.6])
def test_short_odd_and_repeated_texts(spark, least):
    rng = random.Random(7)
    base = ["", "a", "ab", "ba", "aaaa", "aaaaa", "aaaa", "ß", "SS", "𝒳y", "z" * 250, "ab" * 150] + ["".join(rng.choice("abC") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    asked = base + [edited(t, rng) for t in base if t]
    left = spark.createDataFrame([*enumerate(asked), (-1, None)], "id long, t string")
    right = spark.createDataFrame([*enumerate(base), (999, None)], "row_index long, t string")
    got = {r.id: r.row_index for r in matching.fuzzy(left, "id", F.col("t"), F.lit(1), right, F.col("t"), F.lit(1), least).collect()}
    want = {i: best(t, list(enumerate(base)), least) for i, t in enumerate(asked)}
    assert got == {i: w for i, w in want.items() if w is not None}


def test_blocks_nulls_and_empty_tables(spark):
    left = spark.createDataFrame([(1, "abc", "x"), (2, "abc", None), (3, "abc", "y")], "id long, t string, b string")
    right = spark.createDataFrame([(7, "ABC", "x"), (3, "abc", "x"), (9, "abd", "y")], "row_index long, t string, b string")
    args = (F.col("t"), F.col("b"))
    assert [tuple(r) for r in matching.fuzzy(left, "id", *args, right, *args).collect()] == [(1, 3, 1.0)]
    assert matching.fuzzy(left.limit(0), "id", *args, right, *args).count() == 0
    assert matching.fuzzy(left, "id", *args, right.limit(0), *args).count() == 0


def test_urls_of_the_query(spark, sf):
    import re

    from gristmill.plans import proxy

    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    host = lambda u: re.match("https?://([^/]+)", u).group(1)
    got = {r.page_id: r.row_index for r in proxy.queries()["j14_near_urls"](spark, sf).collect()}
    want = {}
    for page, url in pages:
        plain = re.sub("[?#].*$", "", re.sub("^http:", "https:", url))
        want[page] = best(plain, sorted((i, u) for i, u in pages if host(u) == host(url)), 0.9)
    assert got == {i: w for i, w in want.items() if w is not None}
