"""Substring dedup: runs of consecutive sentences, hashed, joined globally, covered sentences removed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, as_row, staged, with_outputs

#: A sentence with what follows it up to the next; the parts of a text make up the whole text.
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+[ \t\n\r]*|[^.!?\n]+")
_WHITE = re.compile(r"[ \t\n\r]+")


def runs_of(text: str | None, sentences: int, min_words: int, long_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(position, sentences, 128-bit hash) of each run of a text."""
    plain = [_WHITE.sub(" ", s).strip(" ") for s in SENTENCE.findall((text or "").lower())]
    ends = np.cumsum([0, *(s.count(" ") + 1 for s in plain)]).tolist()
    n, stop = len(plain), 0
    for at in range(n):
        stop = max(stop, at + sentences)
        while stop <= n and ends[stop] - ends[at] < min_words:
            stop += 1
        if stop <= n:
            yield at, stop - at, xxhash.xxh3_128_digest("\n".join(plain[at:stop]))
        if ends[at + 1] - ends[at] >= long_words:
            yield at, 1, xxhash.xxh3_128_digest(plain[at])


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 2, min_words: int = 25, long_words: int = 50) -> DataFrame:
    """Hashes a run from every sentence, of ``sentences`` sentences and as many more as it takes to have
    ``min_words`` words, so that each run of several sentences lies in hashed ones however short its sentences are;
    a sentence of ``long_words`` words is a run too.  Runs are compared in lower case with white space made one space.
    Removes the sentences that any run covers which is not the first of its hash by (id, position).

    Returns the input's columns with the text reassembled, and n_sentences (before) and n_removed.  A null
    or empty text has no sentences and becomes ''.  A text with fewer sentences or words has no run and stays.
    Rows with a null id stay as they are and count for nothing.  Rows of one id and one text are one
    document; rows of one id and other texts are told apart by a hash of the text.  A hot run is counted by partial
    sums, and its rows are joined by plain equi-joins that the adaptive planner can split.
    """
    key = [P + "id", P + "t"]
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(key[0]), F.xxhash64(text_col).alias(key[1]), F.col(text_col).alias(P + "text"))
    id_type = base.schema[P + "id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                found = [(row, *run) for row, text in enumerate(part.column(2).to_pylist()) for run in runs_of(text, sentences, min_words, long_words)]
                own = pa.array([f[0] for f in found], pa.int64())
                h = np.frombuffer(b"".join(f[3] for f in found), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(own), part.column(1).take(own), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
                    names=[*key, "pos", "length", "h1", "h2"],
                )

    runs = staged(base.mapInArrow(hashed, f"`{key[0]}` {id_type}, `{key[1]}` long, pos int, length int, h1 long, h2 long"), "runs")
    at = F.struct(*key, "pos")
    often = staged(runs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "often")
    again = staged(runs.join(often, ["h1", "h2"]), "again")
    first = staged(again.groupBy("h1", "h2").agg(F.min(at).alias("first")), "first")
    later = again.join(first, ["h1", "h2"]).where(at != F.col("first"))
    gone = later.groupBy(*key).agg(F.collect_set(F.struct("pos", "length")).alias(P + "runs"))
    spread = F.flatten(F.transform(P + "runs", lambda r: F.sequence(r["pos"], r["pos"] + r["length"] - 1)))
    gone = gone.select(*key, F.array_distinct(spread).alias(P + "gone"))

    @F.pandas_udf("text string, n_sentences long, n_removed long")
    def reassembled(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for text, positions in zip(texts, gone):
            parts = SENTENCE.findall(text or "")
            away = set() if positions is None else set(positions.tolist())
            out.append(("".join(s for i, s in enumerate(parts) if i not in away) if away else text or "", len(parts), len(away)))
        return pd.DataFrame(out, columns=["text", "n_sentences", "n_removed"])

    whole = docs.select(as_row(docs), F.col(id_col).alias(key[0]), F.xxhash64(text_col).alias(key[1]), F.col(text_col).alias(P + "text"))
    whole = whole.join(gone, key, "left").withColumn(P + "new", reassembled(P + "text", P + "gone"))
    new = F.col(P + "new")
    return with_outputs(whole, P + "row", {text_col: new["text"], "n_sentences": new["n_sentences"], "n_removed": new["n_removed"]})
