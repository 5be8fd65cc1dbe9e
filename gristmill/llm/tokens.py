"""Encoding whole texts by a public tokenizer, word pieces cached."""

from __future__ import annotations

import codecs
import json
import os
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES, keep_caches_of

#: Words kept per worker between texts; older ones go in halves, which bounds the worker's memory.
CACHE = 500_000
MARKS = string.punctuation
_MARKS = frozenset(MARKS)
#: Words that one call of the merge model takes.
AT_ONCE = 200


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to token ids, as little-endian ``dtype`` bytes, equal to encoding each whole text.

    A byte-level tokenizer never joins characters across a space that stands before a non-space, nor
    across one or two newlines between non-spaces (two are two tokens).  So a text without other white space is
    cut there, each distinct piece is encoded once by the library, and the ids are joined; any other text is encoded
    whole.  Words of letters go straight to the library's merge model, many in one call, if no merge rule joins a
    word to what opens the next; this spares the library's offset tracking.  Strings of special tokens are
    ordinary text.
    """

    def __init__(self, path: str | None = None, limit: int = CACHE) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path or default_path())
        self.lib.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.limit = limit
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        own = json.loads(self.lib.to_str())
        pre, model = own["pre_tokenizer"] or {}, own["model"]
        #: Only for this kind of tokenizer do the cuts above hold.
        self.cuts = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and not own["normalizer"] and model["type"] == "BPE" and not model.get("dropout")
        if self.cuts:
            self.model = self.lib.model
            self.model._resize_cache(0)
            self.code = "H" if self.dtype.itemsize == 2 else "I"
            self.newline = self._ids(["\n"])[0]
            self.marks: dict[str, bytes] = {}
            kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
            own = {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in kept)}
            #: Bytes to the alphabet of byte-level tokenizers.
            self.alphabet = "".join(own[b] for b in range(256))
            opening = (own[32], own[10])
            back = {c: b for b, c in own.items()}

            def joins(a: str, b: str) -> bool:
                """Whether words of letters could hold this merge across the opening of a word."""
                if not (b[0] in opening and a.strip("".join(opening)) or a[-1] == opening[1]):
                    return False
                text = bytes(back[c] for c in a + b).decode("utf-8", "surrogateescape")
                return text.strip() != "" and all(c in " \n" or c.isalpha() or "\udc80" <= c <= "\udcff" for c in text)

            rules = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            self.at_once = 1 if any(joins(a, b) for a, b in rules) else AT_ONCE
            self.opens = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.opens[[i for token, i in model["vocab"].items() if token[0] in opening]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.lib.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each with a space or a newline in front of it."""
        tokenize, alphabet, ids = self.model.tokenize, self.alphabet, array(self.code)
        for at in range(0, len(words), self.at_once):
            mapped = codecs.charmap_decode("".join(words[at : at + self.at_once]).encode(), "strict", alphabet)[0]
            ids.extend([t.id for t in tokenize(mapped)])
        raw, size = ids.tobytes(), self.dtype.itemsize
        cuts = (np.flatnonzero(self.opens[np.frombuffer(raw, self.dtype)]) * size).tolist()
        if self.at_once == 1 or len(cuts) != len(words):
            return self._ids(words)
        return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]

    def _mark(self, end: str) -> bytes | None:
        """Ids of trailing punctuation; null for rare ones, so that they stay few."""
        if end not in self.marks and len(self.marks) < 1000:
            self.marks[end] = self._ids([end])[0]
        return self.marks.get(end)

    def _known(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of distinct pieces; null for a piece that can't be cut off.  Words and rare pieces are kept, words with marks
        at their end are put together from the two."""
        if len(self.cache) > self.limit // 2:
            self.cache, self.older = {}, self.cache
        cache, older, marks, mark = self.cache, self.older, self.marks, self._mark
        ids = list(map(cache.get, pieces))
        ended, lacking = [], []
        for at, x in enumerate(ids):
            if x is None:
                p = pieces[at]
                if p[-1:] in _MARKS:
                    stem = p.rstrip(MARKS)
                    end = p[len(stem) :]
                    core = stem[1:] if stem[:1] == "\n" else stem
                    if core.isalpha() and (core.isascii() or max(core) < "\u0600") and (end in marks or mark(end) is not None):
                        ended.append((at, stem, end))
                        if stem not in cache:
                            lacking.append(stem)
                        continue
                lacking.append(p)
        words, rest = [], []
        for p in dict.fromkeys(lacking):
            x = older.get(p)
            if x is not None:
                cache[p] = x
                continue
            core = p[1:] if p[:1] == "\n" else p
            if core.isalpha() and (core.isascii() or max(core) < "\u0600"):
                words.append(p)
            elif core and core.split() == [core]:
                rest.append(p)
        cache.update(zip(words, self._words([w if w[0] == "\n" else " " + w for w in words])))
        cache.update(zip(rest, self._ids([p if p[0] == "\n" else " " + p for p in rest])))
        whole = {at: cache[stem] + marks[end] for at, stem, end in ended}
        return [x if x is not None else whole[at] if at in whole else cache.get(pieces[at]) for at, x in enumerate(ids)]

    def trim(self) -> None:
        """Give back the older words at a task's end."""
        self.older = {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; null is empty."""
        yield from self.column(pa.array(texts, pa.string())).to_pylist()

    def column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Ids of each text of a column, ``end`` added to each, as a binary column; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts, at, done = [], 0, 0
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        while at < len(texts):  # pieces of a slice are counted in 32 bits
            stop = max(at + 1, int(np.searchsorted(sizes, done + (16 << 20), side="right")))
            parts.append(self._column(texts.slice(at, stop - at), end))
            at, done = stop, int(sizes[stop - 1])
        return pa.concat_arrays(parts) if parts else pa.array([], pa.large_binary())

    def _column(self, texts: pa.Array, end: bytes) -> pa.Array:
        size = self.dtype.itemsize
        if not self.cuts:
            return pa.array([x + end for x in self._ids(texts.to_pylist())], pa.large_binary())
        kind = texts.type
        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n", kind), texts, pa.scalar("", kind)), "\n", " \n"), " ")
        # each text has an empty part before the newline put in front of it: the place of the end before it
        bounds = cut.offsets.to_numpy().astype(np.int64)
        first = bounds[:-1]
        lead = first + 1
        coded = pc.dictionary_encode(cut.flatten())
        every = coded.dictionary
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(every)], every), pa.scalar(" ", kind))[0].as_py().split(" ")
        which = coded.indices.to_numpy()
        ids = self._known(names)
        lone = np.array([p == "\n" for p in names], bool)
        bad = np.array([x is None for x in ids], bool)[which]
        bad[first] = False
        whole = np.zeros(len(texts), bool)
        if bad.any():
            # a newline is a piece if one follows and another piece, or the text's begin, stands before it
            after = np.array([p[:1] == "\n" and x is not None for p, x in zip(names, ids)], bool)[which]
            before = ~bad
            alone = lone[which]
            alone[1:] &= before[:-1]
            alone[:-1] &= after[1:]
            alone[-1] = False
            bad &= ~alone
            empty = lead[lone[which[lead]] & (np.diff(bounds) == 2)]
            bad[empty] = False
            whole = np.logical_or.reduceat(bad, first)
        pool = [self.newline if p == "\n" else x or b"" for p, x in zip(names, ids)]
        special = self._ids(texts.filter(pa.array(whole)).to_pylist()) if whole.any() else []
        pool += [end, *special]
        flat = np.frombuffer(b"".join(pool), self.dtype)
        lens = np.fromiter(map(len, pool), np.int32, len(pool)) // size
        starts = np.cumsum(lens, dtype=np.int32) - lens
        begin, count = starts[which], lens[which]
        begin[lead] += 1  # without the newline put in front
        count[lead] -= 1
        count[first] = 0
        if special:
            count[np.repeat(whole, np.diff(bounds))] = 0
            begin[lead[whole]], count[lead[whole]] = starts[len(names) + 1 :], lens[len(names) + 1 :]
        totals = np.add.reduceat(count, first) + len(end) // size
        begin[first], count[first] = starts[len(names)], len(end) // size
        count[0] = 0
        begin, count = np.append(begin, starts[len(names)]), np.append(count, np.int32(len(end) // size))
        ahead = np.cumsum(count, dtype=np.int32) - count
        at = np.repeat(begin - ahead, count)
        at += np.arange(len(at), dtype=np.int32)
        offsets = np.concatenate([[0], np.cumsum(totals, dtype=np.int64)]) * size
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(flat[at].tobytes())])


_encoders: dict[str | None, Encoder] = {}
CACHES["tokens"] = _encoders.clear


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for ``path``."""
    keep_caches_of("tokens")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
