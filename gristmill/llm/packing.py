"""Lexical retrieval packing: windows of token ids filled by each seed document's BM25 neighbours.

Texts are encoded once and staged.  Document frequencies of token ids are counted over all documents.
Documents are dealt to index shards by content: each has two routing keys, samples of its ids that favour
rare ones and that documents with the same rare ids tend to share; a sort by them brings lexical neighbours
into one shard wherever they stand in the input, and a key of any number of documents is split like others.  A
shard holds about ``shard_tokens`` ids and ``shard_docs`` documents at most, and has a BM25 inverted index of its own.

A seed document fills its windows first; then its unused neighbours of the shard, best first, fill what is
left of its last window.  The neighbour that is cut by the window's end fills the next window and is its
seed.  Every window but the last of a shard is full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .tokens import encoder

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Index:
    """The inverted index of one shard: per term its documents and BM25 weights.  A term that many documents hold has a
    row of weights instead, one per document; there are few of these, as all rows have eight times the postings at most."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, k1: float = 1.2, b: float = 0.75, often: int = 8) -> None:
        self.docs, self.n = docs, len(docs)
        sizes = np.array([len(d) for d in docs])
        bits = max(1, int(len(idf) - 1).bit_length())
        kind = np.uint32 if self.n << bits < 1 << 32 else np.uint64
        keys = np.concatenate(docs).astype(kind)
        keys |= np.repeat(np.arange(self.n).astype(kind) << kind(bits), sizes)
        keys.sort()
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        tf, keys = np.diff(np.append(at, len(keys))), keys[at]
        doc, term = (keys >> kind(bits)).astype(np.int32), (keys & kind((1 << bits) - 1)).astype(np.uint16 if bits <= 16 else np.int64)
        weight = (idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / max(1.0, sizes.mean())))).astype(np.float32)
        held = np.bincount(term, minlength=len(idf))
        wide = held * often >= max(self.n, 64)
        self.row = np.cumsum(wide) - 1
        self.rows = np.zeros((int(wide.sum()), self.n), np.float32)
        mine = wide[term]
        self.rows[self.row[term[mine]], doc[mine]] = weight[mine]
        # a seed asks for all its terms that another document of the shard has
        known = (held > 1) & (idf > 0)
        asked = known[term]
        self.wide, self.narrow = (self._by_doc(doc, term, asked & m) for m in (mine, ~mine))
        self.sums = None
        if self.n <= 4096:  # many seeds for each document: their sums over rows of weights at once
            asks = np.zeros((self.n, len(self.rows)), np.float32)
            asks[doc[asked & mine], self.row[term[asked & mine]]] = 1
            self.sums = asks @ self.rows
        by_term = np.flatnonzero(~mine)
        by_term = by_term[np.argsort(term[by_term], kind="stable")]
        self.p_start = np.searchsorted(term[by_term], np.arange(len(idf) + 1))
        self.p_doc, self.p_weight = doc[by_term], weight[by_term]

    def _by_doc(self, doc: np.ndarray, term: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(doc[some], np.arange(self.n + 1)), term[some].astype(np.int64)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents by all terms of the seed."""
        start, terms = self.narrow
        terms = terms[start[seed] : start[seed + 1]]
        spans = [slice(a, b) for a, b in zip(self.p_start[terms].tolist(), self.p_start[terms + 1].tolist())]
        found = np.bincount(np.concatenate([self.p_doc[s] for s in spans]), np.concatenate([self.p_weight[s] for s in spans]), self.n) if spans else np.zeros(self.n)
        if self.sums is not None:
            return found + self.sums[seed]
        start, terms = self.wide
        return found + self.rows[self.row[terms[start[seed] : start[seed + 1]]]].sum(0)

    def neighbours(self, seed: int, used: np.ndarray, some: int = 32) -> Iterator[int]:
        """Unused documents that share a term, by descending score, ties by position; sorted as far as asked."""
        scores = self.scores(seed)
        scores[used] = 0
        left = np.flatnonzero(scores)
        while len(left):
            own = scores[left]
            least = np.partition(own, len(own) - some)[len(own) - some] if some < len(own) else 0
            now = left[own >= least]
            yield from now[np.lexsort((now, -scores[now]))].tolist()
            left, some = left[own < least], some * 4


def pack(docs: list[np.ndarray], idf: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard, each id in exactly one piece."""
    index = Index(docs, idf)
    used = np.zeros(len(docs), bool)
    free, sequence, offset = 0, 0, 0
    while free < len(docs):
        if used[free]:
            free += 1
            continue
        queue, seed = iter((free,)), None
        while (doc := next(queue, None)) is not None:
            used[doc] = True
            at, size = 0, len(docs[doc])
            while at < size:
                take = min(size - at, window - offset)
                yield doc, at, take, sequence, offset
                at, offset = at + take, offset + take
                if offset == window:
                    sequence, offset, seed = sequence + 1, 0, None
            if offset == 0:  # the window is full; the next unused document is a new seed
                break
            if seed is None:
                seed, queue = doc, index.neighbours(doc, used)


def routing(idf: np.ndarray, shared: np.ndarray, keys: int = 2, seed: int = 17) -> np.ndarray:
    """Per key the place of each id in a random order that favours rare ids; ids of one document come last.  The
    least place of its ids is a document's routing key."""
    draws = -np.log(np.random.default_rng(seed).random((keys, len(idf)))) / np.maximum(idf, 1e-9)
    draws[:, ~shared] = np.inf
    return np.argsort(np.argsort(draws, axis=1, kind="stable"), axis=1, kind="stable").astype(np.int32)


def _flat(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column and where each row's begin, with the end of the last."""
    if not len(column):
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]].view(dtype)
    return flat, (bounds - bounds[0]).astype(np.int64) // dtype.itemsize


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 21, shard_docs: int = 1 << 14) -> DataFrame:
    """One row per piece: id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id
    and offset.  A sequence has at most ``window`` ids; the others are filled but for the last of a shard.

    Null texts are empty: the end id alone.  Null and repeated ids and repeated rows are documents like
    others.  An empty table gives an empty result.  Extra columns are not read.  Sequence ids are unique,
    not gapless.  Document frequencies are one number per token id, whatever the number of documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        held, none, docs = np.zeros(1 << 16 if enc.dtype.itemsize == 2 else enc.lib.get_vocab_size() + 1, np.int64), None, 0
        seen = np.zeros(len(held), bool)
        for batch in batches:
            ids = enc.column(batch.column(1), end)
            flat, bounds = _flat(ids, enc.dtype)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                seen[flat[a:b]] = True
                terms = np.flatnonzero(seen)
                held[terms] += 1
                seen[terms] = False
            none, docs = pa.nulls(1, batch.column(0).type), docs + len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids.cast(pa.binary()), pa.array(np.diff(bounds)), pa.nulls(len(ids), pa.binary())], names=["id", "ids", "n", "held"])
        enc.trim()
        if none is not None:  # the task's document frequencies
            yield pa.RecordBatch.from_arrays([none, pa.nulls(1, pa.binary()), pa.array([docs], pa.int64()), pa.array([held.astype("<i8").tobytes()], pa.binary())], names=["id", "ids", "n", "held"])

    encoded = staged(rows.mapInArrow(encode, f"id {id_type}, ids binary, n long, held binary"), "encoded")
    texts, tasks = encoded.where("held is null"), encoded.where("held is not null")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                held = np.frombuffer(x, "<i8")
                total = held.copy() if total is None else total + held
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    counts = tasks.select("held").mapInArrow(add, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n_docs = tasks.agg(F.sum("n")).first()[0] or 0
    n_ids = texts.agg(F.sum("n")).first()[0] or 0
    df = np.zeros(max((r.term for r in counts), default=0) + 1)
    for r in counts:
        df[r.term] = r.n
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)) * (df > 0)
    # three numbers per token id, whatever the number of documents
    known = spark.sparkContext.broadcast((idf, routing(idf, df > 1)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, (_, places) = encoder(tokenizer).dtype, known.value
        for batch in batches:
            flat, bounds = _flat(batch.column(1), dtype)
            keys = [np.minimum.reduceat(p[flat], bounds[:-1]) for p in places] if len(flat) else [np.zeros(0, np.int32)] * len(places)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, keys)], names=["id", "ids", "k1", "k2"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, task, shard = encoder(tokenizer).dtype, TaskContext.get().partitionId(), 0
        ids, docs, tokens = [], [], 0

        def flush() -> pa.RecordBatch:
            out = list(pack(docs, known.value[0], window))
            doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*out))
            crc = [zlib.crc32(docs[d][s : s + k].astype("<u4").tobytes()) for d, s, k, *_ in out]
            sizes = np.array([len(d) for d in docs], np.int64)
            base = (task << 40) + (shard << 24)
            return pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc.tolist()], id_arrow), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(base + sequence), pa.array(offset)], names=["id", *NAMES])

        for batch in batches:
            id_arrow = batch.column(0).type
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                docs.append(np.frombuffer(x, dtype))
                tokens += len(docs[-1])
                if tokens >= shard_tokens or len(docs) == shard_docs:
                    yield flush()
                    ids, docs, tokens, shard = [], [], 0, shard + 1
        if docs:
            yield flush()

    routed = texts.select("id", "ids").mapInArrow(route, f"id {id_type}, ids binary, k1 int, k2 int")
    order = ["k1", "k2", F.xxhash64("id", "ids")]
    parts = max(1, -(-n_ids // (2 * shard_tokens)))
    dealt = routed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.select("id", "ids").mapInArrow(fill, f"id {id_type}, {PIECES}").withColumnRenamed("id", id_col)
