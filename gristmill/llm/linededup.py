"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, as_row, staged, with_outputs

WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def key_hash(key: Column) -> Column:
    """128 bits that stand for the key."""
    return F.unhex(F.md5(F.encode(key, "UTF-8")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """Lines whose key has at least ``min_chars`` code points and stands in at least ``min_docs`` documents
    stay in the document of the smallest id only, there each time.

    Returns the input's columns with the text reassembled, and n_lines (before) and n_dropped.  Null and
    empty texts are one empty line and become ''.  Rows of one id are one document.  Rows without an id
    are left as they are and count for no line.  A hot line is counted by partial sums, and its rows are
    joined back by a plain equi-join that the adaptive planner can split.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    own = [P + "id", P + "t"]
    keys = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(P + "id"), F.xxhash64(text_col).alias(P + "t"), F.posexplode(F.transform(lines, line_key)).alias(P + "pos", P + "key"))
    keys = keys.where(F.length(P + "key") >= min_chars).select(*own, P + "pos", key_hash(F.col(P + "key")).alias(P + "h"))
    found = keys.groupBy(P + "h").agg(F.count_distinct(P + "id").alias(P + "n"), F.min(P + "id").alias(P + "first"))
    common = staged(found.where(F.col(P + "n") >= min_docs).select(P + "h", P + "first"), "lines")
    drop = keys.join(common, P + "h").where(F.col(P + "id") != F.col(P + "first"))
    drop = drop.groupBy(*own).agg(F.collect_set(P + "pos").alias(P + "drop"))
    rows = docs.select(as_row(docs), F.col(id_col).alias(P + "id"), F.xxhash64(text_col).alias(P + "t"), lines.alias(P + "lines"))
    rows = rows.join(drop, own, "left")
    # positions that stay, by a hash set, in order
    stay = F.array_except(F.sequence(F.lit(1), F.size(P + "lines")), F.transform(P + "drop", lambda i: i + 1))
    kept = F.transform(stay, lambda i: F.element_at(F.col(P + "lines"), i))
    rows = rows.withColumn(P + "kept", F.when(F.col(P + "drop").isNull(), F.col(P + "lines")).otherwise(kept))
    return with_outputs(rows, P + "row", {
        text_col: F.array_join(P + "kept", "\n"), "n_lines": F.size(P + "lines").cast("long"),
        "n_dropped": (F.size(P + "lines") - F.size(P + "kept")).cast("long"),
    })
