"""Byte-level BPE from a file of ranks: texts to token ids by numpy matrices, and ids back to bytes.

A text is split by the tokenizer's pattern; each distinct piece of a slice of texts becomes a row of token ids, and rows
of alike length one padded matrix.  In each round every row merges its leftmost pair of minimum rank, found through a
hash table of all pairs that merge; finished rows leave, and the column that a merge empties is closed up.

Odd rows: a null text is empty and has no ids; an empty table gives no rows; repeated rows are encoded alike; very long
texts are cut where no piece can span and very long pieces are merged by a heap instead of a matrix; columns of the names
of outputs are replaced, all others pass through.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import CACHES, keep_caches_of

#: Bytes of text that are encoded at a time, characters of a text after which it is cut, cells of a matrix.
SLICE, LONG_TEXT, CELLS = 2 << 20, 1 << 20, 1 << 18
#: Pieces of more bytes than the widest matrix go through a heap: a merge a round would take the square of the length.
WIDEST = 256
NONE = np.int32(np.iinfo(np.int32).max)
#: No piece spans a space that stands before a character which isn't white space, whatever stands before it.
_CUT = re.compile(r" (?=\S)")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of a ragged array, one after the other, and their lengths."""
    n = lens[which]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - (ends - n), n)
    return flat[at], n


class PairTable:
    """Ranks of pairs of ids by open addressing; ``NONE`` where a pair doesn't merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, size: int) -> None:
        self.size = np.int64(size)
        keys = left.astype(np.int64) * self.size + right
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.ranks, self.probes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32), 0
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            self.probes += 1
            _, first = np.unique(slot[todo], return_index=True)
            first = first[self.keys[slot[todo[first]]] < 0]
            put = todo[first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], rank[put]
            todo = np.delete(todo, first)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; an id below 0 is padding."""
        keys = left.astype(np.int64) * self.size + right
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], NONE)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class ByteBPE:
    """An encoder and decoder for one file of ranks and one pattern."""

    def __init__(self, path: str | None = None, pattern: str | None = None) -> None:
        import regex

        with open(path or default_ranks(), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.find = regex.compile(pattern or default_pattern()).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        self.lens = np.zeros(size, np.int64)
        names = [b""] * size
        for token, i in self.ranks.items():
            names[i], self.lens[i] = token, len(token)
        self.bytes, self.starts = np.frombuffer(b"".join(names), np.uint8), np.cumsum(self.lens) - self.lens
        self.known = self.lens > 0
        get = self.ranks.get
        pairs = [(a, b, r) for token, r in self.ranks.items() for k in range(1, len(token)) if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None]
        left, right, rank = (np.array(x, np.int32) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int32),) * 3
        self.rank_of = PairTable(left, right, rank, size)

    def _matrix(self, rows: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merges padded rows; yields (rows, lengths, ids one after the other) as rows get done."""

        def ranks_at(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            return self.rank_of(left.ravel(), right.ravel()).reshape(left.shape)

        ranks = ranks_at(ids[:, :-1], ids[:, 1:])
        while True:
            if ranks.shape[1]:
                best = ranks.argmin(1)  # the leftmost of the least
                low = ranks[np.arange(len(rows)), best]
                live = low < NONE
            else:
                best = low = live = np.zeros(len(rows), bool)
            if not live.all():
                done = ~live
                yield rows[done], lens[done], ids[done][np.arange(ids.shape[1]) < lens[done, None]]
                rows, ids, lens, ranks, best, low = rows[live], ids[live], lens[live], ranks[live], best[live], low[live]
            if not len(rows):
                return
            at = np.arange(len(rows))
            ids[at, best] = low  # a token's id is its rank
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > best[:, None]), 1)
            lens = lens - 1
            cols = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, cols + (cols >= best[:, None]), 1)
            before = np.flatnonzero(best > 0)
            ranks[before, best[before] - 1] = self.rank_of(ids[before, best[before] - 1], ids[before, best[before]])
            after = np.flatnonzero(best < ranks.shape[1])
            ranks[after, best[after]] = self.rank_of(ids[after, best[after]], ids[after, best[after] + 1])

    def _heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place), neighbours as links."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        at = self.rank_of(ids[:-1], ids[1:]).tolist()
        ids, following, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(at) if r < NONE]
        heapq.heapify(heap)
        at.append(int(NONE))
        one = lambda a, b: int(self.rank_of(np.array([a]), np.array([b]))[0])
        while heap:
            r, i = heapq.heappop(heap)
            if at[i] != r:
                continue
            gone = following[i]
            ids[i], at[gone], following[i] = r, -1, following[gone]
            if following[i] < n:
                before[following[i]] = i
            for k, other in ((i, following[i]), (before[i], i)):
                if k >= 0:
                    at[k] = one(ids[k], ids[other]) if other < n else int(NONE)
                    if at[k] < NONE:
                        heapq.heappush(heap, (at[k], k))
        return np.array([x for x, r in zip(ids, at) if r >= 0], np.int32)

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces as a ragged array: (ids, starts, lengths)."""
        lens = np.zeros(len(pieces), np.int64)
        parts, starts, size = [], np.zeros(len(pieces), np.int64), 0

        def put(rows: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
            nonlocal size
            lens[rows], starts[rows] = n, size + np.cumsum(n) - n
            parts.append(ids)
            size += len(ids)

        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int32)
        known = np.flatnonzero(whole >= 0)
        put(known, np.ones(len(known), np.int64), whole[known])
        rest = np.flatnonzero(whole < 0)
        size_of = np.array([len(pieces[i]) for i in rest], np.int64)
        width, low = 4, 0
        while width <= WIDEST:
            mine = rest[(size_of > low) & (size_of <= width)]
            for a in range(0, len(mine), CELLS // width):
                rows = mine[a : a + CELLS // width]
                raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
                n = np.array([len(pieces[i]) for i in rows], np.int64)
                for made in self._matrix(rows, np.where(np.arange(width) < n[:, None], self.single[raw], np.int32(-1)), n):
                    put(*made)
            width, low = 2 * width, width
        for i in rest[size_of > low]:
            ids = self._heap(pieces[i])
            put(np.array([i]), np.array([len(ids)]), ids)
        return np.concatenate(parts), starts, lens

    def _chunks(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct chunks that no piece spans, the chunks of all texts in order, and how many each text has."""
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(cut.flatten())
        names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        lead = np.ones(len(which), bool)
        lead[bounds[:-1]] = False
        opens = np.array([p != "" and not p[0].isspace() for p in names], bool)
        odd = np.flatnonzero(np.logical_or.reduceat(lead & ~opens[which], bounds[:-1]))
        codes, each = np.unique(2 * which + lead, return_inverse=True)
        chunks = [(" " if c & 1 else "") + names[c >> 1] for c in codes.tolist()]
        counts = np.diff(bounds)
        if len(odd):  # spaces beside other white space: cut by the rule itself
            own: dict[str, int] = {}
            parts, last = [], 0
            for t in odd.tolist():
                first, *more = _CUT.split(texts[t].as_py())
                made = [own.setdefault(c, len(chunks) + len(own)) for c in (first, *(" " + m for m in more))]
                parts += [each[last : bounds[t]], np.array(made, np.int64)]
                last, counts[t] = bounds[t + 1], len(made)
            each = np.concatenate([*parts, each[last:]])
            chunks += own
        return chunks, each, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        cuts = np.ones(len(texts), np.int64)
        if (pc.binary_length(texts).to_numpy(zero_copy_only=False) > LONG_TEXT).any():
            parts = [list(_segments(t)) for t in texts.to_pylist()]
            cuts = np.array([len(p) for p in parts], np.int64)
            texts = pa.array([s for p in parts for s in p], pa.large_string())
        chunks, each, counts = self._chunks(texts)
        found = list(map(self.find, chunks))
        own: dict[str, int] = {}
        flat = np.array([own.setdefault(p, len(own)) for pieces in found for p in pieces], np.int64)
        n = np.array([len(pieces) for pieces in found], np.int64)
        ids, starts, lens = self.pieces([p.encode() for p in own])
        ids, of_piece = gather(ids, starts, lens, flat)
        ends = np.append(0, np.cumsum(of_piece))
        upto = np.append(0, np.cumsum(n))
        starts, lens = ends[upto[:-1]], ends[upto[1:]] - ends[upto[:-1]]
        ids, of_chunk = gather(ids, starts, lens, each)
        ends = np.append(0, np.cumsum(of_chunk))
        upto = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(cuts))]
        return ids, np.diff(ends[upto])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and how many each has."""
        if len(ids) and not (int(ids.max()) < len(self.known) and self.known[ids].all()):
            raise ValueError("an id that the ranks don't have")
        return gather(self.bytes, self.starts, self.lens, ids.astype(np.int64))


def _segments(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > LONG_TEXT:
        m = _CUT.search(text, at + LONG_TEXT)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


_made: dict[tuple, ByteBPE] = {}
CACHES["bpe"] = _made.clear


def byte_bpe(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """The worker's encoder."""
    keep_caches_of("bpe")
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBPE(path, pattern)
    return _made[path, pattern]


def _ragged(values: np.ndarray, counts: np.ndarray, each: int) -> pa.Array:
    offsets = np.append(0, np.cumsum(counts)).astype(np.int64) * each
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, done + SLICE, side="right")))
        yield batch.slice(at, stop - at)
        at, done = stop, int(sizes[stop - 1])


def encode_texts(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens", path: str | None = None, pattern: str | None = None, keep_text: bool = True) -> DataFrame:
    """Adds the token ids of a text (little-endian unsigned 32-bit integers, a binary column) and their number.  ``path`` is a
    file of ranks that every executor can read."""
    kept = [f for f in docs.schema if f.name not in (ids_col, count_col) and (keep_text or f.name != text_col)]
    schema = StructType([*kept, StructField(ids_col, BinaryType(), False), StructField(count_col, LongType(), False)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for whole in batches:
            for batch in _slices(whole, text_col):
                ids, counts = bpe.encode(batch.column(text_col))
                columns = [batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, _ragged(ids.astype("<u4"), counts, 4), pa.array(counts, pa.int64())], [*names, ids_col, count_col])

    return docs.mapInArrow(run, schema)


def decode_ids(docs: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the bytes that the ids of a binary column stand for; null is empty, an unknown id is an error."""
    kept = [f for f in docs.schema if f.name != bytes_col]
    schema = StructType([*kept, StructField(bytes_col, BinaryType(), False)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for whole in batches:
            for batch in _slices(whole, ids_col):
                column = pc.fill_null(batch.column(ids_col).cast(pa.large_binary()), b"")
                sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // 4
                out, n = bpe.decode(np.frombuffer(b"".join(column.to_pylist()), "<u4"))
                ends, upto = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(sizes))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), _ragged(out, np.diff(ends[upto]), 1)], [*names, bytes_col])

    return docs.mapInArrow(run, schema)
