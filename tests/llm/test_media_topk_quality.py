import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.llm.media import DamagedImage, cosine_hash, decode_png, encode_media, encode_png, media_features
from gristmill.llm.quality import SIZE, Machine, features, fit_quality, held_out, labelled_features, score_documents
from gristmill.llm.topk import top_products

from .helpers import DDL, clashing, empty, odd


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=700), st.integers(0, 4), st.sampled_from([3, 192]))
def test_png_round_trip(payload, kind, width):
    rows, n = decode_png(encode_png(payload, width, kind))
    assert n == len(payload) and rows.shape[1] == width and rows.tobytes() == payload.ljust(max(width, -(-len(payload) // width) * width), b" ")


def test_png_of_mixed_filters():
    rows = np.random.default_rng(1).integers(0, 256, (10, 8), np.uint8)
    whole = [np.frombuffer(zlib.decompress(encode_png(rows.tobytes(), 8, k)[61:-16]), np.uint8).reshape(10, 9) for k in range(5)]
    mixed = np.stack([whole[y % 5][y] for y in range(10)])
    from gristmill.llm.media import _unfiltered

    assert (_unfiltered(mixed) == rows).all()


@pytest.mark.parametrize("at", [0, 12, 20, 50, 70, -3])
def test_png_damage(at):
    data = bytearray(encode_png(b"some text " * 50))
    data[at] ^= 1
    with pytest.raises(DamagedImage):
        decode_png(bytes(data))
    with pytest.raises(DamagedImage):
        decode_png(bytes(data[:-1]))


def test_hash_of_low_frequencies():
    rows = np.tile(np.arange(192, dtype=np.uint8), (40, 1))
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert len(cosine_hash(rows)) == 16 and far(cosine_hash(rows), cosine_hash(rows.T.copy())) > 10
    blocks = np.random.default_rng(4).integers(0, 200, (8, 8)).repeat(20, 0).repeat(24, 1).astype(np.uint8)
    rough = (blocks + np.random.default_rng(5).integers(0, 9, blocks.shape)).astype(np.uint8)
    other = np.random.default_rng(6).integers(0, 200, (8, 8)).repeat(20, 0).repeat(24, 1).astype(np.uint8)
    assert far(cosine_hash(blocks), cosine_hash(blocks + np.uint8(9))) == 0 and far(cosine_hash(blocks), cosine_hash(rough)) <= 6 < 12 < far(cosine_hash(blocks), cosine_hash(other))


def brute_hash(rows):
    """The transform term by term."""
    n, m = rows.shape
    at = lambda k, size: [k * size // 32, (k + 1) * size // 32]
    mean = lambda y, x: rows[slice(*at(y, n)), slice(*at(x, m))].mean()
    small = np.array([[mean(y, x) for x in range(32)] for y in range(32)])
    wave = lambda k, i: np.cos(np.pi * (i + 0.5) * k / 32)
    found = np.array([sum(small[y, x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)])
    return found, np.median(found[1:])


def test_hash_against_brute_force():
    rows = np.random.default_rng(7).integers(0, 256, (64, 192)).astype(np.uint8)
    found, middle = brute_hash(rows)
    sure = abs(found - middle) > 1e-6
    got = np.unpackbits(np.frombuffer(bytes.fromhex(cosine_hash(rows)), np.uint8)).astype(bool)
    assert (got[sure] == (found > middle)[sure]).all() and sure.sum() > 60


@pytest.mark.parametrize("make", [odd, clashing])
def test_media_of_odd_rows(spark, make):
    out = media_features(encode_media(make(spark))).collect()
    texts = {}
    for r in odd(spark).collect():
        texts.setdefault(r.doc_id, (r.text or "").encode())
    assert len(out) == 11
    for r in out:
        raw = texts[r.doc_id]
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert media_features(encode_media(empty(spark))).count() == 0


def brute_top(rows, k):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "rank": F.lit(1)})


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_top_products_against_brute_force(spark, spread):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, np.exp(spread * rng.normal()), 12)]) for i in range(400)]
    rows += [(i + 1000, rows[3][1]) for i in range(30)] + [(50, rows[9][1]), (None, rows[0][1]), (2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2004, []), (2005, [2.0, -1.0])]
    df = vectors(spark, rows)
    for options in ({}, {"block": 16, "query_block": 3}):
        got = sorted(tuple(r) for r in top_products(df, F.col("vec_id") % 50 == 0, **options).collect())
        assert got == brute_top(rows, 5)


def test_top_products_of_few_and_large(spark):
    assert top_products(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert top_products(vectors(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    rows = [(0, [3e8, 1.0]), (1, [3e8, 2.0]), (2, [3e8, -1.0]), (3, [-3e8, 0.5])]
    got = sorted(tuple(r) for r in top_products(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect())
    assert [(q, r, i) for q, r, i, _ in got] == [(q, r, i) for q, r, i, _ in brute_top(rows, 5)]


def test_machine_learns_and_is_linear_in_features():
    rng = np.random.default_rng(0)
    parts, y = [], []
    for _ in range(600):  # an interaction: label 1 if just one of two features stands
        a, b = rng.random(2) < 0.5
        ids = np.array([10 + a, 20 + b])
        parts.append((ids, np.ones(2, np.float32)))
        y.append(float(a != b))
    m = Machine(size=64).fit(parts, np.array(y), epochs=60)
    assert ((m.scores(parts) > 0.5) == np.array(y)).mean() > 0.98
    ids, x = np.array([3, 10, 21]), np.array([0.5, 1.0, 2.0], np.float32)
    pairs = sum(float(m.v[i] @ m.v[j]) * xi * xj for k, (i, xi) in enumerate(zip(ids, x)) for j, xj in list(zip(ids, x))[:k])
    want = m.bias + float((m.w[ids] * x).sum()) + pairs
    assert abs(float(m.margins(np.array([0]), ids, x)[0][0]) - want) < 1e-4


@pytest.mark.parametrize("text", [None, "", " ", "!!! ???", "a" * 100_000, "é 漢字 \x00 x"])
def test_features_of_odd_texts(text):
    ids, x = features(text, None)
    assert (np.diff(ids) > 0).all() and ids.max() < SIZE and np.isfinite(x).all()


def test_quality_of_junk(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(40)) + "."
    junk = lambda: rng.choice([(rng.choice(words) + " ") * 40, prose().upper().replace(" ", "!! "), prose().replace(" ", " | ")])
    rows = [(i, junk() if i % 4 == 0 else prose(), "en", "s", 100) for i in range(600)]
    docs = spark.createDataFrame(rows, DDL)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = score_documents(docs, fit_quality(docs, labels, ~held_out(F.col("doc_id")))).withColumn("out", held_out(F.col("doc_id"))).collect()
    test = [r for r in out if r.out]
    assert {r.out for r in out} == {True, False} and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.out for r in out)
    assert sum((r.score >= 0.7) == (r.doc_id % 4 != 0) for r in test) / len(test) > 0.95


def test_repeated_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i} of {i % 7}", "", "", 0) for i in range(900)], DDL)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert labelled_features(docs, labels, F.lit(True), max_rows=100).count() == 100
    assert fit_quality(docs, labels, F.lit(True), max_rows=100).w.any()


def test_quality_on_labels_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = score_documents(docs, fit_quality(docs, labels, ~held_out(F.col("doc_id")))).where(held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    good, bad = [r.score for r in out if r.quality == 1], [r.score for r in out if r.quality == 0]
    assert len(out) > 50 and sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(g >= 0.7 for g in good) / len(good) > 0.95


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    machine = fit_quality(clashing(spark), labels, F.lit(True))
    out = score_documents(clashing(spark), machine)
    assert out.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in out.collect()) and out.count() == 11
    none = fit_quality(odd(spark), labels.limit(0), F.lit(True))
    assert {round(r.score, 6) for r in score_documents(odd(spark), none).collect()} == {0.5}
    assert score_documents(empty(spark), none).count() == 0


def test_media_query_undoes_a_real_filter(spark, sf, monkeypatch):
    from gristmill.llm import queries

    stored, keep = [], queries.staged
    monkeypatch.setattr(queries, "staged", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    got = {r.doc_id: r.payload_sha256 for r in queries.op8_media_columns(spark, sf).collect()}
    for r in stored[0].collect():
        at = r.media.index(b"IDAT")
        lines = zlib.decompress(r.media[at + 4 : at + 4 + int.from_bytes(r.media[at - 4 : at], "big")])
        assert set(lines[:: 192 + 1]) == {2}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        text = (r.text or "").encode()
        assert got[r.doc_id] == hashlib.sha256(text.ljust(max(192, -(-len(text) // 192) * 192), b" ")).hexdigest()
