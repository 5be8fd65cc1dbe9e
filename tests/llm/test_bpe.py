"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import bpe
from gristmill.llm.queries import op11_byte_bpe

from .helpers import LONG, clashing, empty, odd


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_ranks(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE()


def texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnop étñ中 \n\t'"
    yield from ["", " ", "  ", "a", "a  b", "a   b", "end\n\n Next", "a \nfoo\n \nx", " lead", "trail ", "don't we'll 'S", "12345 678", "a b  c\x1cd \x1d e", "\0 \0\0", "🙂🙂 é́", LONG]
    yield from ["x" * 5000, "ab" * 3000 + " " + "é" * 400, "=" * 300 + "-" * 700, " " * 1000 + "z", "\n" * 600, "".join(rng.choice("abcdef") for _ in range(4000))]
    for _ in range(300):
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(1, 200)))


def both(own, library, rows):
    ids, counts = own.encode(pa.array(rows, pa.string()))
    ends = np.append(0, np.cumsum(counts))
    for i, t in enumerate(rows):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode_ordinary(t or ""), repr(t)[:80]
    assert own.decode(ids)[0].tobytes() == "".join(t or "" for t in rows).encode()


def test_same_ids_as_the_library(own, library):
    both(own, library, [*texts(), None])


def test_long_texts_are_cut_where_no_piece_spans(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    both(own, library, [*texts(), None])


def test_narrow_matrices_and_heaps_agree(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "WIDEST", 4)
    monkeypatch.setattr(bpe, "CELLS", 64)
    both(own, library, list(texts()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\tab'1"))), max_size=4))
def test_any_text(rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_ranks(), "rb"))} if not hasattr(test_any_text, "lib") else None
    if ranks:
        test_any_text.lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        test_any_text.own = bpe.ByteBPE()
    both(test_any_text.own, test_any_text.lib, rows)


def test_pair_table_finds_all_and_no_other():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 500 * 500, 40_000))
    rank = rng.permutation(len(keys)).astype(np.int32)
    table = bpe.PairTable((keys // 500).astype(np.int32), (keys % 500).astype(np.int32), rank, 500)
    every = np.arange(500 * 500)
    want = np.full(len(every), bpe.NONE)
    want[keys] = rank
    assert (table((every // 500).astype(np.int32), (every % 500).astype(np.int32)) == want).all()
    assert (table(np.array([-1, 3]), np.array([2, -1])) == bpe.NONE).all()


def test_unknown_ids_are_an_error(own):
    with pytest.raises(ValueError, match="ranks"):
        own.decode(np.array([60_000], np.uint32))


def test_odd_rows(spark, library):
    for df in (odd(spark), clashing(spark), odd(spark).withColumnsRenamed({"lang": "ids", "source": "decoded"})):
        done = bpe.decode_ids(bpe.encode_texts(df))
        assert set(df.columns) <= set(done.columns)
        for r in done.collect():
            assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) // 4
            assert bytes(r.decoded) == (r.text or "").encode()
        assert done.count() == df.count()
    assert bpe.decode_ids(bpe.encode_texts(empty(spark))).count() == 0


def test_query(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op11_byte_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(library.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
