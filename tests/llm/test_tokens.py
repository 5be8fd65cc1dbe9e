import io
import random
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm.packing import Index, pack_documents
from gristmill.llm.tokenfile import TokenReader, TokenWriter, fetch_documents, tokens_on_disk, write_token_files
from gristmill.llm.tokens import Encoder

from .helpers import DDL, clashing, empty, odd

ENCODER = Encoder()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abAB12 .,!'\n\t\r  éß漢😀-|:;<>")), max_size=30))
def test_cached_pieces_equal_whole_texts(text):
    assert list(ENCODER.encode([text])) == ENCODER._ids([text])


def test_special_strings_and_small_caches():
    texts = ["<|endoftext|>", "a <|endoftext|>b", None, "it's we'll", "x" * 5000]
    small = Encoder(limit=2)
    for _ in range(3):
        assert list(small.encode(texts)) == ENCODER._ids([t or "" for t in texts])


def written(docs, frame_ids=4):
    out = io.BytesIO()
    w = TokenWriter(out, "<u2", frame_ids)
    for i, ids in docs:
        w.add(i, np.array(ids, "<u2").tobytes())
    w.close()
    return out.getvalue()


def test_round_trip_of_frames():
    docs = [(5, [1, 2, 3]), (None, []), (7, list(range(11))), (7, [9])]
    data = written(docs)
    r = TokenReader(io.BytesIO(data), len(data))
    assert [(None if n else int(i), r.read(k).tolist()) for k, (i, n) in enumerate(zip(r.ids, r.nulls))] == docs
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(whole, "<u2").tolist() == [x for _, ids in docs for x in ids]


def test_reads_only_the_frames_asked_for():
    data = written([(i, [i] * 4) for i in range(50)])

    class Counting(io.BytesIO):
        spans = []

        def read(self, n=-1):
            Counting.spans.append((self.tell(), n))
            return super().read(n)

    r = TokenReader(Counting(data), len(data))
    Counting.spans.clear()
    assert r.read(30).tolist() == [30] * 4
    assert Counting.spans == [(int(r.offsets[30]), int(r.table[30, 0]))]


@pytest.mark.parametrize("at", [3, 20, -5, -30, -60])
def test_damage_is_noticed(at):
    data = bytearray(written([(i, list(range(i, i + 9))) for i in range(8)]))
    data[at] ^= 0x5A
    with pytest.raises((ValueError, zstandard.ZstdError)):
        r = TokenReader(io.BytesIO(bytes(data)), len(data))
        for i in range(len(r)):
            r.read(i)


def expected(df):
    docs = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, np.append(np.frombuffer(ENCODER._ids([t or ""])[0], "<u2").astype("<u4"), np.uint32(0))) for i, t in docs]


@pytest.mark.parametrize("make", [odd, clashing])
def test_files_hold_all_documents_in_order(spark, make):
    got = sorted(map(tuple, tokens_on_disk(spark, make(spark)).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    want, at = [], 0
    for i, ids in expected(odd(spark)):
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [g[0] for g in got][0] == 0 and sum(g[2] for g in got) == at and got[-1][0] + got[-1][2] == at
    assert sorted(g[2:] for g in got) == sorted(w[2:] for w in want)
    assert [g[1] for g in got] == [w[1] for w in want] and all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))


def test_empty_tables(spark):
    assert tokens_on_disk(spark, empty(spark)).count() == 0
    assert pack_documents(empty(spark)).count() == 0


def check_pieces(pieces, want, window):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    total = {}
    for i, ids in want:
        total[i] = total.get(i, 0) + len(ids)
    assert {i: sum(p.length for p in ps) for i, ps in by_doc.items()} == total
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        assert ps[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(ps, ps[1:]))
        assert ps[-1].offset + ps[-1].length <= window
    return by_doc, by_seq


@pytest.mark.parametrize("make", [odd, clashing])
def test_packing_places_each_id_once(spark, make):
    pieces, want = pack_documents(make(spark), window=64).collect(), expected(odd(spark))
    by_doc, by_seq = check_pieces(pieces, want, 64)
    for i, ids in want:
        if i in (None, 2):
            continue
        for p in by_doc[i]:
            assert p.doc_tokens == len(ids) and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    short = [s for s in by_seq.values() if s[-1].offset + s[-1].length < 64]
    assert len(short) <= 4  # the last of each shard


def test_neighbours_share_words(spark):
    rng = random.Random(1)
    topics = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)] for _ in range(4)]
    rows = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(12)), "", "", 0) for i in range(80)]
    pieces = pack_documents(spark.createDataFrame(rows, DDL).coalesce(1), window=256).collect()
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, set()).add(p.doc_id % 4)
    assert sum(len(s) for s in by_seq.values()) <= 1.6 * len(by_seq)


def test_neighbours_by_all_terms_against_brute_force():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 400, rng.integers(60, 200)).astype("<u2") for _ in range(40)]
    held = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=400)
    idf = np.log1p((40 - held + 0.5) / (held + 0.5)) * (held > 0)
    index, mean, used = Index(docs, idf), np.mean([len(d) for d in docs]), np.zeros(40, bool)
    for seed in range(40):
        assert len(np.unique(docs[seed])) > 24
        tf = np.array([np.bincount(d, minlength=400) for d in docs])[:, np.unique(docs[seed])]
        sizes = np.array([len(d) for d in docs])[:, None]
        scores = (idf[np.unique(docs[seed])] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes / mean))).sum(1)
        used[:] = False
        used[[seed, (seed + 1) % 40]] = True
        want = [d for d in np.argsort(-scores, kind="stable") if not used[d]]
        assert list(index.neighbours(seed, used, some=3)) == want == list(index.neighbours(seed, used))


def test_copies_that_stand_apart_meet_in_a_window(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    pairs = [text(40) for _ in range(150)]
    rows = [(i, t, "", "", 0) for i, t in enumerate([*pairs, *(text(40) for _ in range(900)), *pairs])]
    pieces = pack_documents(spark.createDataFrame(rows, DDL).repartition(8), window=1024, shard_tokens=1 << 14).collect()
    assert len({p.sequence_id >> 24 for p in pieces}) > 8  # shards
    windows = {}
    for p in pieces:
        windows.setdefault(p.doc_id, set()).add(p.sequence_id)
    together = sum(bool(windows[i] & windows[i + 1050]) for i in range(150))
    assert together > 120


def test_many_short_documents_take_linear_time():
    import time

    from gristmill.llm.packing import pack

    idf = np.ones(300)
    docs = [np.array([i % 290 + 1, 0], "<u2") for i in range(1 << 14)]
    began = time.process_time()
    assert sum(k for _, _, k, _, _ in pack(docs, idf, 1024)) == 1 << 15
    assert time.process_time() - began < 5


def test_documents_by_their_ids(spark, tmp_path):
    rows = [(i * 3, f"text number {i} " * (i % 7), "", "", 0) for i in range(200)]
    manifest = write_token_files(spark.createDataFrame(rows, DDL), str(tmp_path), file_tokens=100, partitions=3)
    assert manifest.count() > 5
    got = {r.doc_id: r.tokens for r in fetch_documents(manifest, str(tmp_path), [3, 300, 301, 597]).collect()}
    want = {i: [*np.frombuffer(ENCODER._ids([rows[i // 3][1]])[0], "<u2").tolist(), 0] for i in (3, 300, 597)}
    assert got == want and fetch_documents(manifest, str(tmp_path), []).count() == 0


def test_files_hold_a_bounded_number_of_documents(spark, tmp_path):
    from pyspark.sql import functions as F

    from gristmill.llm.tokenfile import read_token_files, write_token_files

    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    manifest = write_token_files(docs, f"{tmp_path}/t", partitions=1, file_docs=8)
    assert sorted(r[0] for r in manifest.select("n_docs").collect()) == [2] + [8] * 6
    got = read_token_files(manifest, f"{tmp_path}/t").orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(i, i, 1) for i in range(50)]


def test_only_own_tables_are_dropped(spark):
    from gristmill.llm.common import drop_staged, staged, staged_now, staging

    other = staged(spark.range(3), "other")
    with staging() as mine:
        staged(spark.range(4), "one")
        with staging() as inner:
            staged(spark.range(5), "two")
    staged(spark.range(6), "three")
    assert len(mine) == len(inner) == 1 and {*mine, *inner} < staged_now(spark)
    before = staged_now(spark)
    drop_staged(spark, mine)
    assert staged_now(spark) == before - set(mine) and other.count() == 3
