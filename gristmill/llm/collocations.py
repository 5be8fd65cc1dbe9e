"""Phrase collocations: exact counts of word n-grams from suffix automata, scored against their parts.

Texts become sequences of word ids, staged once in shards of one language.  Each shard builds a generalised suffix automaton,
bounded in depth: states are classes of phrases with the same end positions, a state's suffix link is its phrases' longest
suffix that ends in more places, and its count is the number of its end positions.  The automaton gives each phrase with
its count; counts are summed over shards.  Phrases that can't reach the least count are kept out by fixed-size bitmaps of frequent
words and pairs: every part of a frequent phrase is frequent, so a bit too many costs time only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import with_rank
from .common import keep_caches_of, staged

#: Words of a shard, bytes of text that are cut into words at a time, 64-bit words of a bitmap (4 MB).
SHARD, SLICE, BITMAP = 1 << 19, 2 << 20, 1 << 19
DEEPEST = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
WORDS = [f"w{i}" for i in range(1, DEEPEST + 1)]


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of texts (null: empty), lower-cased, for each whether it opens a piece, and the text it stands in."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data and len(texts) else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    # a word ends where its text does, too
    cuts = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(raw))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
    starts, ends = np.sort(np.concatenate([np.flatnonzero(edge == 1), cuts])), np.sort(np.concatenate([np.flatnonzero(edge == -1), cuts]))
    sizes = ends - starts
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int64)), pa.py_buffer(raw[inside].tobytes()))
    breaks = np.cumsum(kind == 2)
    seen = breaks[starts] if len(starts) else np.zeros(0, np.int64)
    text = np.searchsorted(bounds, starts, side="right") - 1
    opens = np.ones(len(starts), bool)
    opens[1:] = (seen[1:] != seen[:-1]) | (text[1:] != text[:-1])
    return words, opens, text


class SuffixAutomaton:
    """The suffix automaton of sequences, bounded in depth, of words 0, 1, 2, ... parted by -1.

    Built by levels instead of online: the phrases of length d that end in the same places are told apart by the word before,
    so sorting (class of length d - 1, word before) gives the classes of length d; those classes, linked to the class of
    their suffix, are the tree of suffix links.  A chain of classes with one set of end positions is one state:
    ``link``, ``longest`` and ``count`` are the states' arrays; ``state`` and ``word`` are the classes', by level.
    """

    def __init__(self, words: np.ndarray, depth: int, joined=None) -> None:
        """``joined(left, right)``: a mask of pairs of neighbours that may stand in a phrase together."""
        n = len(words)
        place = np.flatnonzero(words >= 0)
        base = int(words.max(initial=-1)) + 1
        pair = np.zeros(n, bool)
        pair[1:] = (words[1:] >= 0) & (words[:-1] >= 0)
        if joined is not None:
            at = np.flatnonzero(pair)
            pair[at] = joined(words[at - 1], words[at])
        # how many words a phrase that ends here can have
        barrier = np.where(pair, 0, np.arange(n))
        room = np.arange(n) - np.maximum.accumulate(barrier) + 1 if n else np.zeros(0, np.int64)
        self.word, self.parent, self.counts = [], [], []
        klass = np.zeros(n, np.int64)
        for d in range(1, depth + 1):
            place = place[room[place] >= d]
            names, klass[place], counts = np.unique(klass[place] * base + words[place - (d - 1)], return_inverse=True, return_counts=True)
            word, parent = (names % base, names // base) if base else (names, names)
            for held, x in ((self.word, word), (self.parent, parent), (self.counts, counts)):
                held.append(x.astype(np.int32))
        self._states()

    def _states(self) -> None:
        """Classes to states: a class whose end positions are those of its suffix's class is of the same state."""
        links, longest, counts, self.state = [np.array([-1])], [np.array([0])], [np.array([0])], []
        above, size = np.zeros(1, np.int32), 1
        for d, (parent, count) in enumerate(zip(self.parent, self.counts), 1):
            same = (count == self.counts[d - 2][parent]) if d > 1 else np.zeros(len(count), bool)
            mine = above[parent]
            new = np.flatnonzero(~same)
            links.append(mine[new])
            mine = mine.copy()
            mine[new] = size + np.arange(len(new), dtype=np.int32)
            size += len(new)
            longest.append(np.full(len(new), d))
            counts.append(count[new])
            self.state.append(mine)
            above = mine
        self.link, self.longest, self.count = (np.concatenate(x) for x in (links, longest, counts))
        for d, mine in enumerate(self.state, 1):
            self.longest[mine] = np.maximum(self.longest[mine], d)

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """All phrases of ``length`` words, first word first, and how often each ends somewhere: a state stands for its
        phrases from the length of its link's longest, plus 1, to its own longest."""
        mine = self.state[length - 1]
        out = np.empty((len(mine), length), np.int32)
        at = np.arange(len(mine))
        for k in range(length):
            d = length - 1 - k
            out[:, k] = self.word[d][at]
            at = self.parent[d][at]
        return out, self.count[mine]


def _hashes(words: list[str], lang: str, seed: int) -> np.ndarray:
    lead = xxhash.xxh64_intdigest(lang.encode(), seed)
    return np.array([xxhash.xxh64_intdigest(w.encode(), lead) for w in words], np.uint64).view(np.int64)


def shards_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 0, shard: int = SHARD) -> DataFrame:
    """Shards (lang, words, counts, hashes, seq): distinct words with counts and 64-bit hashes, and the sequence of their
    numbers as little-endian 32-bit integers, -1 between pieces.  Nothing is left out."""

    def close(lang: str, parts: list[tuple[pa.Array, np.ndarray]]) -> dict:
        words = pa.concat_arrays([w for w, _ in parts])
        coded = words.dictionary_encode()
        ids, opens = coded.indices.to_numpy().astype(np.int32), np.concatenate([o for _, o in parts])
        names = coded.dictionary.to_pylist()
        seq = np.insert(ids, np.flatnonzero(opens), np.int32(-1))
        return {"lang": lang, "words": names, "counts": np.bincount(ids, minlength=len(names)), "hashes": _hashes(names, lang, seed).tolist(), "seq": seq.astype("<i4").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_caches_of("collocations")
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        for whole in batches:
            for batch in _slices(whole):
                langs = batch.column(0).cast(pa.string()).fill_null("und").dictionary_encode()
                words, opens, text = cut_words(batch.column(1))
                of = langs.indices.to_numpy()[text] if len(text) else text
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    mine = np.flatnonzero(of == i)
                    if len(mine):
                        held.setdefault(lang, []).append((words.take(pa.array(mine)), opens[mine]))
                        sizes[lang] = sizes.get(lang, 0) + len(mine)
                for lang in [x for x, n in sizes.items() if n >= shard] or ([max(sizes, key=sizes.get)] if sum(sizes.values()) >= 2 * shard else []):
                    yield pa.RecordBatch.from_pylist([close(lang, held.pop(lang))], SHARD_SCHEMA)
                    del sizes[lang]
        for lang, parts in held.items():
            yield pa.RecordBatch.from_pylist([close(lang, parts)], SHARD_SCHEMA)

    return docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "lang string, words array<string>, counts array<long>, hashes array<long>, seq binary")


SHARD_SCHEMA = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("seq", pa.binary())])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, done + SLICE, side="right")))
        yield batch.slice(at, stop - at)
        at, done = stop, int(sizes[stop - 1])


def _bit(hashes: np.ndarray, size: int) -> np.ndarray:
    """A place in a bitmap of ``size`` 64-bit words, a power of two."""
    return (hashes.view(np.uint64) >> np.uint64(59 - size.bit_length())).astype(np.int64)


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of a pair of hashes, as ``pair_hash`` makes it."""
    return (left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (right.view(np.uint64) ^ (right.view(np.uint64) >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def bitmap(rows: DataFrame, columns: list[str], size: int) -> np.ndarray:
    """A bitmap of ``size`` 64-bit words, whatever the number of rows, with the bits of a hash, or a pair of hashes, set: each task
    sets bits of its own, words of the bitmap are merged by OR, and only set words are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint64)
        for batch in batches:
            own = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            at = _bit(own[0] if len(own) == 1 else _mixed(*own), size)
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        held = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(bits[held].view(np.int64))], ["at", "bits"])

    merged = rows.select(*columns).mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size, np.int64)
    out[merged.column("at").to_numpy()] = merged.column("bits").to_numpy()
    return out.view(np.uint64)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bit(hashes, len(bits))
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def phrase_counts(shards: DataFrame, lengths: range, words, pairs=None) -> DataFrame:
    """(w1, ..., n): counts in each shard of phrases of ``lengths`` words, as hashes, null beyond a phrase's end.  ``words`` and
    ``pairs`` are broadcast bitmaps; a word or pair without its bit parts a sequence."""
    deepest = lengths[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_caches_of("collocations")
        for batch in batches:
            for row in range(batch.num_rows):
                hashes = batch.column(0)[row].values.to_numpy()
                seq = np.frombuffer(batch.column(1)[row].as_py(), "<i4").astype(np.int64)
                if not len(hashes):
                    continue
                good = _has(words.value, hashes)
                seq = np.where((seq >= 0) & good[seq], seq, -1)
                pa.default_memory_pool().release_unused()
                joined = (lambda a, b: _has(pairs.value, _mixed(hashes[a], hashes[b]))) if pairs is not None else None
                automaton = SuffixAutomaton(seq, deepest, joined)
                for length in lengths:
                    found, counts = automaton.phrases(length)
                    for a in range(0, len(found), 1 << 17):
                        part = found[a : a + (1 << 17)]
                        columns = [pa.array(hashes[part[:, k]]) if k < length else pa.nulls(len(part), pa.int64()) for k in range(deepest)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[a : a + (1 << 17)].astype(np.int64))], [*WORDS[:deepest], "n"])

    kind = ", ".join(f"{w} long" for w in WORDS[:deepest]) + ", n long"
    return shards.select("hashes", "seq").mapInArrow(run, kind)


def _summed(counts: DataFrame, least: int) -> DataFrame:
    keys = [c for c in counts.columns if c != "n"]
    return counts.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _keyed(words: list[Column]) -> list[Column]:
    """A phrase as four columns, 0 beyond its end, and its length."""
    return [(words[i] if i < len(words) else F.lit(0).cast("long")).alias(f"k{i}") for i in range(DEEPEST)] + [F.lit(len(words)).alias("size")]


KEY = [*(f"k{i}" for i in range(DEEPEST)), "size"]


def _parts(phrases: DataFrame, own: list[Column], cuts: list[tuple[int, int, int, int]]) -> DataFrame:
    """``own`` columns of the phrases of each length, the cut, and the key of the part from word ``first`` to ``stop``, for each
    (length, first, stop, cut) of ``cuts``."""
    made = None
    for size, first, stop, cut in cuts:
        part = phrases.where(F.col("size") == size).select(*own, F.lit(cut).alias("cut"), *_keyed([F.col(f"k{i}") for i in range(first, stop)]))
        made = part if made is None else made.unionByName(part)
    return made


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, covered: int = 80, scale: int = 2_000_000, seed: int = 0, shard: int = SHARD, bitmap_size: int = BITMAP) -> DataFrame:
    """Each language's ``top`` phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    Pieces are parted by . , ; : ! ? and line ends, words by spaces and tabs; A-Z are lower-cased.  Null texts are empty, a null language is
    ``und``, empty tables and languages without a phrase give no rows, repeated rows count, other columns are ignored.  A phrase of a = f(phrase) >= ``least`` has
    for each cut l = f(first part), r = f(rest) and floor(scale * a / (l + r)); the least counts, of ties the first cut.
    A phrase goes whose words lie in a longer one of at least ``covered`` percent of its count.  Products are decimals
    of 38 digits.  ``shard`` words make a shard, ``bitmap_size`` 64-bit words a bitmap.  Two words of one hash are an error; another ``seed`` avoids it.
    """
    spark = docs.sparkSession
    shards = staged(shards_of(docs, text_col, lang_col, seed, shard), "word_shards")
    words = shards.select("lang", F.explode(F.arrays_zip("words", "counts", "hashes")).alias("x"))
    words = words.groupBy(F.col("x.hashes").alias("w1")).agg(
        F.sum("x.counts").alias("f"), F.min("x.words").alias("word"), F.max("x.words").alias("other"), F.min("lang").alias("lang"), F.max("lang").alias("other_lang")
    )
    words = staged(words, "words")
    if not words.where("word <> other OR lang <> other_lang").isEmpty():
        raise ValueError("two words have one hash; choose another seed")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least).select("w1", "f", "word", "lang")
    good = spark.sparkContext.broadcast(bitmap(frequent, ["w1"], bitmap_size))
    pairs = staged(_summed(phrase_counts(shards, range(2, 3), good), least), "pairs")
    joined = spark.sparkContext.broadcast(bitmap(pairs, ["w1", "w2"], bitmap_size))
    longer = staged(_summed(phrase_counts(shards, range(3, DEEPEST + 1), good, joined), least), "phrases")

    of = lambda t, size: t.select(*_keyed([F.col(w) for w in WORDS[:size]]), "f")
    known = of(frequent, 1).unionByName(of(pairs, 2)).unionByName(of(longer.where("w4 IS NULL"), 3)).unionByName(of(longer.where("w4 IS NOT NULL"), 4))
    known = staged(known, "frequent")
    candidates = known.where("size >= 2").withColumnRenamed("f", "a")

    counts = known.select(*(F.col(c).alias(f"of_{c}") for c in KEY), "f")
    scored = None
    for side in ("l", "r"):
        cuts = [(size, 0, k, k) if side == "l" else (size, k, size, k) for size in range(2, DEEPEST + 1) for k in range(1, size)]
        asked = _parts(candidates, [*(F.col(c).alias(f"own_{c}") for c in KEY), F.col("a")], cuts)
        asked = asked.select(*(f"own_{c}" for c in KEY), "a", "cut", *(F.col(c).alias(f"part_{c}") for c in KEY))
        on = [asked[f"part_{c}"] == counts[f"of_{c}"] for c in KEY]
        got = asked.join(counts, on).select(*(f"own_{c}" for c in KEY), "a", "cut", F.col("f").alias(side))
        scored = got if scored is None else scored.join(got.drop("a"), [*(f"own_{c}" for c in KEY), "cut"])
    value = F.expr(f"(CAST({scale} AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(20, 0))) div CAST(l + r AS DECIMAL(20, 0))")
    scored = scored.withColumn("score", value).groupBy(*(F.col(f"own_{c}").alias(c) for c in KEY)).agg(F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    # a phrase without its first word is its suffix link, without its last the link of the reversed phrase; their links again
    inner = [(size, i, i + n, n) for size in range(3, DEEPEST + 1) for n in range(2, size) for i in range(size - n + 1)]
    inside = _parts(candidates, [F.col("a").alias("by")], inner).drop("cut").groupBy(*KEY).agg(F.max("by").alias("by"))
    scored = scored.join(inside, KEY, "left").where(F.expr(f"by IS NULL OR CAST(100 AS DECIMAL(3, 0)) * CAST(by AS DECIMAL(20, 0)) < CAST({covered} AS DECIMAL(3, 0)) * CAST(a AS DECIMAL(20, 0))"))

    names = scored.select(*KEY, "a", "best", F.posexplode(F.slice(F.array(*(f"k{i}" for i in range(DEEPEST))), 1, F.col("size"))).alias("at", "w1"))
    names = names.join(frequent.select("w1", "word", "lang"), "w1").groupBy(*KEY).agg(
        F.max("a").alias("a"), F.max("best").alias("best"), F.min("lang").alias("lang"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase")
    )
    rows = staged(names.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").cast("long").alias("score")), "scored_phrases")
    ranked = with_rank(rows, ["lang"], [-F.col("score"), -F.col("a"), "phrase"], "rank").where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
