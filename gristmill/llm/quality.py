"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), linear in the number of
features.  It is fit on at most ``max_rows`` labelled rows, those of the smallest hashes, by one task;
every text is scored whole.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import CACHES, keep_caches_of

BITS, RANK = 18, 8
#: Structure statistics have this many levels each; their features follow those of hashed words.
LEVELS = 24
STATS = ("words", "word_length", "distinct", "commonest", "repeats", "upper", "marks", "digits", "line_length", "wordless", "short", "end_marks", "capitals", "metadata")
SIZE = (1 << BITS) + LEVELS * len(STATS)
_EDGE = re.compile(r"^\W+|\W+$")
_MARKS = frozenset(string.punctuation) - frozenset(".,;:?\"')")

# Byte classes: 1 upper-case letter, 2 mark, 3 digit, 4 letter or byte of a longer character, 0 white space.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_CLASS[65:91], _CLASS[48:58], _CLASS[:33] = 1, 3, 0


class _Words(dict):
    """Word to its hashed feature; starts anew when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        plain = _EDGE.sub("", word.lower())
        found = self[word] = xxhash.xxh32_intdigest(plain) >> (32 - BITS) if plain else -1
        return found


_words = _Words()
CACHES["quality"] = _words.clear


def _ends_in_mark(word: str) -> bool:
    """Whether a word ends in an ASCII mark that doesn't close a plain clause."""
    return word[-1] in _MARKS


def features(text: str | None, metadata: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, ascending, and values; a null text is an empty one, null metadata a level of its own."""
    text = text or ""
    words = text.split()
    n = len(words)
    ids = np.fromiter(map(_words.__getitem__, words), np.int64, n)
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=5)
    marks = max(1, int(kinds[1:].sum()))
    found, counts = np.unique(ids[ids >= 0], return_counts=True)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = text.count("\n") + 1
    share = lambda x, of: x / of if of else 0.0
    stats = (
        np.log2(n + 1) / 16, share(lengths.sum(), n) / 24, share(len(found), n), share(counts.max(initial=0), n), share((ids[1:] == ids[:-1]).sum(), n),
        kinds[1] / marks, min(1.0, 2 * kinds[2] / marks), min(1.0, 2 * kinds[3] / marks), np.log2(len(text) / lines + 1) / 16, share((ids < 0).sum(), n),
        share((lengths <= 3).sum(), n), share(sum(map(_ends_in_mark, words)), n), share(sum(map(str.isupper, words)), n),
    )
    level = [min(LEVELS - 2, int(x * (LEVELS - 1))) for x in stats]
    level.append(LEVELS - 1 if metadata is None or metadata != metadata else min(LEVELS - 2, int(np.log2(max(metadata, 0) + 1))))
    extra = (1 << BITS) + LEVELS * np.arange(len(STATS)) + np.array(level)
    values = np.sqrt(counts)
    values = 0.5 * values / max(1e-9, float(np.sqrt((values**2).sum())))
    return np.concatenate([found, extra]), np.concatenate([values, np.ones(len(STATS))]).astype(np.float32)


def _rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in parts])[:-1]]).astype(np.int64)
    return starts, np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])


class Machine:
    """The factorisation machine; ``fit`` takes mini-batches with AdaGrad steps, in a fixed order;
    few rows are passed more often, for about ``steps`` steps."""

    def __init__(self, size: int = SIZE, rank: int = RANK, seed: int = 3) -> None:
        self.bias, self.w = 0.0, np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, rank)).astype(np.float32)

    def margins(self, starts: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx**2, starts, axis=0)
        return self.bias + np.add.reduceat(self.w[ids] * x, starts) + 0.5 * (sums**2 - squares).sum(1), vx, sums

    def scores(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not parts:
            return np.zeros(0)
        z = self.margins(*_rows(parts))[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, parts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, steps: int = 300, batch: int = 256, rate: float = 0.05, l2: float = 1e-4, seed: int = 4) -> "Machine":
        mean = (y.sum() + 0.5) / (len(y) + 1)
        self.bias = float(np.log(mean / (1 - mean)))
        if len(y) == 0 or y.min() == y.max():
            self.v[:] = 0
            return self
        seen = np.zeros(len(self.w), bool)
        seen[np.concatenate([i for i, _ in parts])] = True
        self.v[~seen] = 0  # features without evidence say nothing
        gw, gv, rng = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3), np.random.default_rng(seed)
        for _ in range(max(epochs, steps * batch // len(y))):
            order = rng.permutation(len(parts))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                starts, ids, x = _rows([parts[i] for i in pick])
                z, vx, sums = self.margins(starts, ids, x)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]).astype(np.float32)
                each = np.repeat(np.arange(len(pick)), np.diff(np.append(starts, len(ids))))
                pull = (error[each] * x / len(pick))[:, None]
                own, place = np.unique(ids, return_inverse=True)
                dw = np.bincount(place, pull[:, 0], len(own)).astype(np.float32) + l2 * self.w[own]
                by = np.argsort(place, kind="stable")
                dv = np.add.reduceat((pull * (sums[each] - vx))[by], np.searchsorted(place[by], np.arange(len(own))), axis=0) + l2 * self.v[own]
                gw[own] += dw**2
                gv[own] += dv**2
                self.w[own] -= rate * dw / np.sqrt(gw[own])
                self.v[own] -= rate * dv / np.sqrt(gv[own])
                self.bias -= rate * float(error.mean())
        return self


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2


def labelled_features(docs: DataFrame, labels: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata_col: str | None = "n_chars", max_rows: int = 20_000) -> DataFrame:
    """Labels and features of at most ``max_rows`` labelled documents, those of the smallest hashes: id, y, i and x."""
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & train_on).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    meta = F.col(metadata_col).cast("double") if metadata_col in docs.columns else F.lit(None).cast("double")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), meta.alias("meta"))
    rows = rows.join(F.broadcast(picked), "id")  # max_rows rows of a number and a label

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_caches_of("quality")
        for b in batches:
            parts = [features(t, m) for t, m in zip(b.column("text").to_pylist(), b.column("meta").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("y"), pa.array([i.astype("<i4").tobytes() for i, _ in parts], pa.binary()), pa.array([x.tobytes() for _, x in parts], pa.binary())], names=["id", "y", "i", "x"])

    every = rows.mapInArrow(extract, "id string, y int, i binary, x binary")
    return every.orderBy(F.xxhash64("id", "i", "x"), "id", "i", "x").limit(max_rows)


def fit_quality(docs: DataFrame, labels: DataFrame, train_on: Column, **options) -> Machine:
    """A machine fit on labelled documents that ``train_on`` holds for, at most ``max_rows`` rows of them, those of
    the smallest hashes; rows of one id count each.  ``options`` are those of ``labelled_features``.  Rows with a null id or label are left out; without rows, or with one class, the machine says the
    (smoothed) share of that class for all.  Extra columns are not read.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("id", "i", "x", "y")))]
        rows.sort(key=lambda r: r[:3])
        parts = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(x, np.float32)) for _, i, x, _ in rows]
        m = Machine().fit(parts, np.array([y for *_, y in rows], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.w.tobytes()], pa.binary()), pa.array([m.v.tobytes()], pa.binary())], names=["bias", "w", "v"])

    sample = labelled_features(docs, labels, train_on, **options)
    model = sample.coalesce(1).mapInArrow(train, "bias double, w binary, v binary").collect()  # one row of fixed size
    machine = Machine()
    machine.bias = model[0]["bias"] if model else 0.0
    machine.w = np.frombuffer(model[0]["w"], np.float32) if model else machine.w
    machine.v = np.frombuffer(model[0]["v"], np.float32).reshape(-1, RANK) if model else machine.v * 0
    return machine


def score_documents(docs: DataFrame, machine: Machine, text_col: str = "text", metadata_col: str | None = "n_chars", score_col: str = "score") -> DataFrame:
    """Adds ``score_col`` from 0 to 1; a null or empty text has one too.  An input column of that name is replaced."""
    model = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))
    keep = [c for c in docs.columns if c.lower() != score_col.lower()]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep))
    schema = StructType([*rows.schema.fields, StructField(score_col, DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_caches_of("quality")
        m = Machine(1, 1)
        m.bias, m.w, m.v = model.value
        for b in batches:
            texts = b.column(keep.index(text_col)).to_pylist()
            meta = b.column(keep.index(metadata_col)).to_pylist() if metadata_col in keep else [None] * len(texts)
            out = [m.scores([features(t, x) for t, x in zip(texts[a : a + 256], meta[a : a + 256])]) for a in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*keep, score_col])

    return rows.mapInArrow(score, schema)
