"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words.  Its weight is its count in the document times the mean inverse document frequency of
its words, which are counted over all documents in a fixed number of hash bins.  (The frequency of a
shingle itself would count the very copies that are looked for.)  Each of bands x rows samples picks a
shingle and a quantised weight; two documents agree in one with the probability of their weighted Jaccard
similarity.  Documents that agree in a whole band are candidates, and candidates are verified exactly.

Within a band's bucket each member is compared with one centre, so a tight group of n copies costs n
comparisons.  Jaccard distance is a metric: a member that missed the centre can only be linked to members
whose distance to the centre differs by at most the allowed distance.  These, if not in one component
by then, are compared in a second pass, as matrices of bounded blocks of a bucket's members; only links that
join components leave a block.  So no candidate link between components is lost, and no pair is a row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHES, as_row, keep_caches_of, staged, tasks_for
from .components import components

#: Hash bins of words' document frequencies: the size of what every executor holds of the corpus.
BINS = 1 << 16
#: Random variates per sample are drawn from a table of this many entries, by a hash of the shingle.
VARIATES = 1 << 16
#: Members of a bucket that a second comparison takes at once, squared.
BLOCK = 512
_WORD = re.compile(r"\w+")


class _Words(dict):
    """Word to 64-bit hash; starts anew when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = _Words()
CACHES["minhash"] = _words.clear


def word_hashes(text: str | None) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, idf: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and weights; a document of fewer words has one shingle of them all, without words none."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    width = min(width, len(words))
    n = len(words) - width + 1
    h, rare = np.zeros(n, np.uint64), np.zeros(n, np.float64)
    each = idf[words >> np.uint64(48)]
    for i in range(width):
        h = (h + words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        rare += each[i : i + n]
    found, first, counts = np.unique(h, return_index=True, return_counts=True)
    return found, (counts * rare[first] / width).astype(np.float32)


class Sampler:
    """Consistent weighted samples, keyed by band."""

    def __init__(self, bands: int, rows: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.r = rng.gamma(2, 1, VARIATES).astype(np.float32)
        self.inverse = 1 / self.r
        self.log_c = np.log(rng.gamma(2, 1, VARIATES)).astype(np.float32)
        self.beta = rng.random(VARIATES, np.float32)
        self.odd = rng.integers(1 << 62, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """One key per band."""
        best = np.full(len(self.odd), np.inf, np.float32)
        item = np.zeros(len(self.odd), np.uint64)
        level = np.zeros(len(self.odd), np.int64)
        every = np.arange(len(self.odd))
        for at in range(0, len(h), 192):  # what fits the processor's cache
            part, log_w = h[at : at + 192], np.log(w[at : at + 192])
            index = ((self.odd[:, None] * part[None]) >> np.uint64(48)).view(np.int64)
            r, beta = self.r.take(index), self.beta.take(index)
            t = log_w * self.inverse.take(index)
            t += beta
            np.floor(t, out=t)
            a = t - beta
            a += 1
            a *= r
            np.subtract(self.log_c.take(index), a, out=a)
            k = a.argmin(1)
            least = a[every, k]
            new = least < best
            best[new], item[new], level[new] = least[new], part[k[new]], t[every, k][new].astype(np.int64)
        mixed = (item ^ (level.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))).reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for j in range(self.rows):
            key = (key ^ mixed[:, j]) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
        return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle vectors."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    both = float(np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64))
    return both / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - both)


def _links(docs: list[tuple], least: float) -> list[tuple[bytes, bytes]]:
    """Links of components, no more than join them: of (root, apart, shingles, weights, total) documents, pairs of
    different roots of which one is apart.

    Smaller weights of two documents are summed by a product of matrices: a shingle has a column for each
    of its weights here, worth its step over the next smaller one, held by documents of at least it.
    """
    n = len(docs)
    totals = np.array([d[4] for d in docs])
    names = {r: i for i, r in enumerate(dict.fromkeys(d[0] for d in docs))}
    root, apart = np.array([names[d[0]] for d in docs]), np.array([d[1] for d in docs])
    both = np.zeros((n, n))
    s, w = np.concatenate([d[2] for d in docs]), np.concatenate([d[3] for d in docs])
    owner = np.repeat(np.arange(n), [len(d[2]) for d in docs])
    order = np.lexsort((w, s))
    s, w, owner = s[order], w[order], owner[order]
    edge = np.append(True, s[1:] != s[:-1])
    size = np.diff(np.append(np.flatnonzero(edge), len(s)))
    shared = np.repeat(size > 1, size)
    s, w, owner, edge = s[shared], w[shared], owner[shared], edge[shared]
    if len(s):
        step = edge | np.append(True, w[1:] != w[:-1])
        column = np.cumsum(step) - 1
        first = column[np.maximum.accumulate(np.where(edge, np.arange(len(s)), 0))]
        value = w[step].astype(np.float64)
        worth = np.where(edge[step], value, value - np.append(0, value[:-1]))
        held = column - first + 1
        who = np.repeat(owner, held)
        which = np.repeat(first, held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        for at in range(0, int(column[-1]) + 1, 4096):
            some = (which >= at) & (which < at + 4096)
            x = np.zeros((n, min(4096, int(column[-1]) + 1 - at)))
            x[who[some], which[some] - at] = 1
            both += (x * worth[at : at + 4096]) @ x.T
    alike = both >= least * (totals[:, None] + totals[None] - both)
    alike &= (root[:, None] != root[None]) & (apart[:, None] | apart[None])
    a, b = (root[x] for x in np.nonzero(np.triu(alike, 1)))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    up, out, of = list(range(len(names))), [], list(names)

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            up[x] = y
            out.append((of[a], of[b]))
    return out


def _fingerprint(words: np.ndarray) -> bytes:
    return hashlib.md5(words.tobytes()).digest()


def word_frequencies(texts: DataFrame) -> np.ndarray:
    """Inverse document frequency per hash bin over all rows of the one-column frame; BINS numbers on the driver."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_caches_of("minhash")
        found, rows = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found[np.unique((word_hashes(text) >> np.uint64(48)).astype(np.int64))] += 1
                rows += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(found[at], rows), pa.int64())], names=["bin", "n"])

    total = texts.mapInArrow(tally, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = {r.bin: r.n for r in total}
    n = counts.pop(-1, 0)
    df = np.ones(BINS)
    for k, v in counts.items():
        df[k] = v
    return np.log1p(max(n, 1) / df)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id and class_id, the least id of its class; ``options`` are those of ``classified``.

    Texts of equal words are one class; classes also join through links, pairs of weighted Jaccard
    similarity of at least ``threshold`` (bands of 5 samples find 99.9 % of pairs at 0.8).  Null, empty
    and wordless texts are classes of their own, or of their id.  Rows with a null id get a null
    class, and take no part.  Rows of one id may have different texts and classes.  Extra columns are not read.
    """
    return classified(docs, id_col, text_col, **options).select(F.col("id").alias(id_col), "class_id")


def classified(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, bands: int = 20, rows: int = 5, width: int = 5) -> DataFrame:
    """``near_duplicates`` with t, a hash of the text, and h, a fingerprint of its words (null without words)."""
    spark = docs.sparkSession
    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    idf = spark.sparkContext.broadcast(word_frequencies(rows_in.select("text")))  # BINS numbers

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_caches_of("minhash")
        sampler = Sampler(bands, rows)
        for batch in batches:
            prints, keys = [], []
            for text in batch.column("text").to_pylist():
                words = word_hashes(text)
                prints.append(_fingerprint(words) if len(words) else None)
                keys.append(sampler.keys(*shingles(words, idf.value, width)) if len(words) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "t", "h", "keys"])

    id_type = rows_in.schema["id"].dataType.simpleString()
    signed = staged(rows_in.mapInArrow(sign, f"id {id_type}, t long, h binary, keys array<bigint>"), "signatures")
    known = signed.where("id is not null and h is not null")
    texts = staged(known.groupBy("h").agg(F.min("id").alias("id"), F.first("keys").alias("keys")), "texts")
    members = texts.select("h", F.explode("keys").alias("key"))
    buckets = staged(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("c"), F.max("h").alias("d")).where("c != d").select("key", "n"), "buckets")
    members = staged(members.join(buckets, "key"), "members")
    # the centre of a bucket is its member that meets most others in all its bands
    met = staged(members.groupBy("h").agg(F.sum("n").alias("met")), "met")
    members = members.join(met, "h")
    centres = staged(members.groupBy("key").agg(F.max(F.struct("met", "h"))["h"].alias("c")), "centres")
    members = staged(members.select("key", "h").join(centres, "key"), "members")
    pairs = staged(members.where("h != c").select(F.col("c").alias("a"), F.col("h").alias("b")).distinct(), "pairs")

    wanted = members.select("h").distinct().join(texts.select("h", "id"), "h")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_caches_of("minhash")
        for batch in batches:
            out = []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                words = word_hashes(text)
                if _fingerprint(words) == h:  # an id may have rows with other texts
                    s, w = shingles(words, idf.value, width)
                    out.append((h, s.tobytes(), w.tobytes(), float(w.sum(dtype=np.float64))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.float64()))], names=["h", "s", "w", "total"])

    found = rows_in.join(wanted, "id").select("h", "text").mapInArrow(vectors, "h binary, s binary, w binary, total double")
    vecs = staged(found.dropDuplicates(["h"]), "vectors")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("s1", "w1", "s2", "w2")}
            sims = [similarity((np.frombuffer(s1, np.uint64), np.frombuffer(w1, np.float32)), (np.frombuffer(s2, np.uint64), np.frombuffer(w2, np.float32))) for s1, w1, s2, w2 in zip(*cols.values())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    def verified(pairs: DataFrame) -> DataFrame:
        left = vecs.select(F.col("h").alias("b"), F.col("s").alias("s2"), F.col("w").alias("w2"))
        right = vecs.select(F.col("h").alias("a"), F.col("s").alias("s1"), F.col("w").alias("w1"))
        return staged(pairs.join(left, "b").join(right, "a").mapInArrow(compare, "a binary, b binary, sim double"), "compared")

    linked = F.col("sim") >= threshold - 1e-6
    first = verified(pairs)
    links = first.where(linked).select("a", "b")
    roots = staged(components(links), "roots")

    # Second pass: members apart from their bucket's centre against the bucket's other components.
    placed = members.join(first.select(F.col("a").alias("c"), F.col("b").alias("h"), "sim"), ["c", "h"], "left")
    placed = placed.join(roots.select(F.col("node").alias("h"), "root"), "h", "left").select("key", "h", "c", F.coalesce("root", "h").alias("root"), (1 - F.coalesce("sim", F.lit(1.0))).alias("dist"))
    placed = placed.where("h != c").join(roots.select(F.col("node").alias("c"), F.col("root").alias("c_root")), "c", "left")
    placed = staged(placed.select("key", "h", "root", "dist", (F.col("root") != F.coalesce("c_root", "c")).alias("apart")), "placed")
    slack = 1 - threshold + 1e-6
    far = F.when(F.col("apart"), F.col("dist"))
    spans = placed.groupBy("key").agg(F.min(far).alias("lo"), F.max(far).alias("hi")).where("lo is not null")
    rest = staged(placed.join(staged(spans, "spans"), "key").where((F.col("dist") >= F.col("lo") - slack) & (F.col("dist") <= F.col("hi") + slack)).select("key", "h", "root", "apart"), "rest")
    # bands whose buckets hold the same members are one; a bucket of one component has nothing to compare
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "h", "apart").cast("decimal(38,0)"))
    sets = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), mark(1).alias("x"), mark(2).alias("y"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2")
    sets = staged(sets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks")), "sets")
    rest = rest.join(sets, "key").withColumn("own", F.pmod(F.xxhash64(F.lit(5), "h"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "h", "root", "apart")
    rest = rest.join(vecs.select("h", "s", "w", "total"), "h")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def links() -> pa.RecordBatch:
            found = _links(held, threshold - 1e-6)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            for *at, h, root, apart, x, w, total in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "h", "root", "apart", "s", "w", "total"))):
                if at != cell:
                    if len(held) > 1:
                        yield links()
                    cell, held = at, []
                held.append((root, apart, np.frombuffer(x, np.uint64), np.frombuffer(w, np.float32), total))
        if len(held) > 1:
            yield links()

    tasks = max(tasks_for(vecs), tasks_for(rows_in))
    cells = rest.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "h", "root", "apart", "s", "w", "total")
    more = staged(cells.mapInArrow(within, "a binary, b binary").distinct(), "more")
    if not more.isEmpty():
        top = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
        nodes = roots.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").withColumn("root", F.col("node")))
        roots = staged(nodes.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    grouped = texts.select("h", "id").join(roots.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    least = grouped.groupBy("root").agg(F.min("id").alias("class_id"))
    classes = staged(grouped.join(staged(least, "classes"), "root").select("h", "class_id"), "members")
    return signed.select("id", "t", "h").join(classes, "h", "left").select("id", "t", "h", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"))


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, of its least id, in the input's columns: where that id has several texts of
    the class, that of the least text hash.  Rows with a null id stay."""
    classes = classified(docs, id_col, text_col, **options).where("id is not null")
    first = classes.groupBy("class_id", F.col("h").isNull().alias("wordless")).agg(F.min(F.struct("id", "t")).alias("first"))
    kept = first.select(F.col("first")["id"].alias("__gm_id"), F.col("first")["t"].alias("__gm_t"))
    rows = docs.select(as_row(docs), F.col(id_col).alias("__gm_id"), F.xxhash64(text_col).alias("__gm_t"))
    alone = rows.where("__gm_id is null").select("__gm_row.*")
    turn = F.row_number().over(Window.partitionBy("__gm_id", "__gm_t").orderBy("__gm_id"))
    return rows.join(kept, ["__gm_id", "__gm_t"], "left_semi").withColumn("__gm_turn", turn).where("__gm_turn = 1").select("__gm_row.*").unionByName(alone)
