"""Mixing sources to target weights, in DataFrame functions only.

Each source's words, its documents one after another, make fixed-length blocks.  Output shards have slots;
each slot draws its source, which makes a shard's counts multinomial, and the few slots that a source drew
beyond its target's number of blocks, picked by hash over all shards, go to the sources that drew too few, so
totals are exact.  The n-th slot of a source is mapped through the source's pseudorandom permutation of block indexes, a new one for
each pass over the source, and blocks are joined by index.  All draws are hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, as_row, staged

WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
BEFORE = (Window.unboundedPreceding, -1)


def permuted(x: Column, n: Column, *key: Column, rounds: int = 8) -> Column:
    """A pseudorandom permutation of 0 to n-1, by ``key``: swap-or-not rounds, each a bijection."""

    def step(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, i), n) - x, n)
        return F.when(F.xxhash64(F.lit(1), *key, i, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x.cast("long"), step)


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """From (source, size) rows: s (number by code point, null last), weight and target.

    Sources share the sum of sizes by weight; a target stops at ``cap`` times its source's size, and the
    excess is shared by weight until none is above.  Sources capped are those of the least cap / weight,
    so one pass in that order finds the level.  One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("s", (F.row_number().over(by_name) - 1).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("s", F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("size") * F.lit(float(cap)))
    all_rows = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "s").rowsBetween(*BEFORE)
    s = s.withColumns({"total": F.sum("size").over(all_rows).cast("double"), "w": F.sum("weight").over(all_rows)})
    level = (F.col("total") - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / (F.col("w") - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    s = s.withColumn("full", level > F.col("cap") / F.col("weight"))
    taken = [F.sum(F.when(F.col("full"), F.col(c)).otherwise(0.0)).over(all_rows) for c in ("cap", "weight")]
    s = s.withColumn("level", (F.col("total") - taken[0]) / (F.col("w") - taken[1]))
    return s.select("source", "s", "size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; maps, which have no order, by their entries in order."""
    return F.xxhash64(*(F.array_sort(F.map_entries(f"`{f.name}`")) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in docs.schema.fields))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, row: Column) -> DataFrame:
    """One row for equal rows, with their number."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(source_col).alias("source"), words.alias("size"), row.alias("r"))
    return rows.groupBy("id", "t", "source", "size", "r").agg(F.count(F.lit(1)).alias("copies"))


class Mix:
    """The plan of a mix: ``sources`` (with targets), ``documents`` (each with its place in its source's
    stream), ``slots`` (shard, s, epoch, block) and ``pieces``, the documents' parts that slots take."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, block_words: int = 64, shard_slots: int = 4096, seed: int = 5, bucket_rows: int = 2_000, row: Column | None = None) -> None:
        self.seed, self.block = F.lit(seed), block_words
        alike = staged(sized(docs, id_col, text_col, source_col, F.lit(0) if row is None else row), "sizes")
        rows = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
        self.sources = staged(self._wanted(targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, cap), cap), "sources")
        self.documents = staged(self._streams(rows, bucket_rows), "streams")
        self.slots = self._slots(shard_slots)

    def _wanted(self, s: DataFrame, cap: float) -> DataFrame:
        """Blocks of each source, and how many slots come nearest its target."""
        length = F.lit(self.block)
        s = s.withColumn("blocks", F.ceil(F.col("size") / length).cast("long"))
        passes = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(int(cap)).cast("long"))).otherwise(0)
        s = s.withColumn("passes", passes.cast("long"))
        rest = F.least(F.round((F.col("target") - F.col("passes") * F.col("size")) / length).cast("long"), F.col("blocks"))
        return s.withColumn("want", F.col("passes") * F.col("blocks") + F.when(F.col("passes") < int(cap), F.greatest(rest, F.lit(0))).otherwise(0))

    def _streams(self, rows: DataFrame, bucket_rows: int) -> DataFrame:
        """Places in the streams, by sums in hash buckets of bounded size and over buckets."""
        rows = rows.join(self.sources.select(F.col("source").alias("of"), "s", F.col("size").alias("source_size"), "target"), rows["source"].eqNullSafe(F.col("of"))).drop("of")
        buckets = max(1, -(-rows.count() // bucket_rows))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(3), "id", "t", "copy"), F.lit(buckets)))
        sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
        sums = sums.select(F.col("s").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(*BEFORE)), F.lit(0)).alias("base"))
        inside = Window.partitionBy("s", "bucket").orderBy("id", "t", "size", "copy", "r")
        rows = rows.withColumns({"n": F.row_number().over(inside), "ahead": F.coalesce(F.sum("size").over(inside.rowsBetween(*BEFORE)), F.lit(0))})
        rows = rows.join(sums, (F.col("s") == F.col("s2")) & (F.col("bucket") == F.col("b2")))
        return rows.select("id", "t", "r", "source", "size", "s", "source_size", "target", "bucket", "n", (F.col("base") + F.col("ahead")).alias("start"))

    def _slots(self, shard_slots: int) -> DataFrame:
        spark = self.sources.sparkSession
        total = self.sources.agg(F.sum("want")).first()[0] or 0
        width = max(1, total // 4096)
        order = Window.orderBy("s")  # a row per source
        ranges = self.sources.select("s", (F.sum("want").over(order)).alias("hi"), "want").withColumn("lo", F.col("hi") - F.col("want")).where("want > 0")
        ranges = ranges.select("s", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("cell"))
        slots = spark.range(total).select("id", F.expr(f"id div {shard_slots}").alias("shard")).withColumn("u", F.pmod(F.xxhash64(self.seed, "shard", "id"), F.lit(max(total, 1))))
        drawn = slots.withColumn("cell", F.expr(f"u div {width}")).join(ranges, "cell").where("u >= lo and u < hi").select("id", "shard", "s")
        counts = staged(drawn.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("n")), "counts")
        # sums over a source's shards: over ranges of shards, then within a range
        far = counts.groupBy("s", F.expr("shard div 4096").alias("far")).agg(F.sum("n").alias("m"))
        far = far.select("s", "far", F.coalesce(F.sum("m").over(Window.partitionBy("s").orderBy("far").rowsBetween(*BEFORE)), F.lit(0)).alias("ahead"))
        near = F.coalesce(F.sum("n").over(Window.partitionBy("s", "far").orderBy("shard").rowsBetween(*BEFORE)), F.lit(0))
        before = counts.withColumn("far", F.expr("shard div 4096")).withColumn("near", near).join(far, ["s", "far"])
        before = before.select(F.col("shard").alias("shard2"), F.col("s").alias("s2"), (F.col("ahead") + F.col("near")).alias("base"))
        own = Window.partitionBy("shard", "s").orderBy("id")  # shard_slots rows at most
        drawn = drawn.withColumn("k", F.row_number().over(own) - 1).join(before, (F.col("shard") == F.col("shard2")) & (F.col("s") == F.col("s2")))
        drawn = drawn.select("id", "shard", "s", (F.col("base") + F.col("k")).alias("rank"))
        got = self.sources.join(counts.groupBy("s").agg(F.sum("n").alias("got")), "s", "left").select("s", "want", F.coalesce("got", F.lit(0)).alias("got"))
        got = got.withColumns({"over": F.greatest(F.col("got") - F.col("want"), F.lit(0)), "under": F.greatest(F.col("want") - F.col("got"), F.lit(0))})
        got = got.withColumns({"over_base": F.coalesce(F.sum("over").over(order.rowsBetween(*BEFORE)), F.lit(0)), "under_base": F.coalesce(F.sum("under").over(order.rowsBetween(*BEFORE)), F.lit(0))})
        got = staged(got, "drawn")
        free = got.where("under > 0").select(F.col("s").alias("to"), "got", "under_base", F.explode(F.sequence(F.col("got"), F.col("want") - 1)).alias("as_rank"))
        free = free.select("to", "as_rank", (F.col("under_base") + F.col("as_rank") - F.col("got")).alias("place"))
        drawn = drawn.join(got.select("s", "want", "got", "over_base"), "s")
        # surplus slots are those of the last places of a permutation, whatever their shards
        drawn = drawn.withColumn("rank", permuted(F.col("rank"), F.col("got"), self.seed, F.lit(23), F.col("s"))).withColumn("place", F.when(F.col("rank") >= F.col("want"), F.col("over_base") + F.col("rank") - F.col("want")))
        moved = drawn.where("place is not null").join(free, "place").select("id", "shard", F.col("to").alias("s"), F.col("as_rank").alias("rank"))
        final = drawn.where("place is null").select("id", "shard", "s", "rank").unionByName(moved).join(self.sources.select("s", "blocks"), "s")
        epoch = F.expr("rank div blocks")
        block = permuted(F.pmod("rank", F.col("blocks")), F.col("blocks"), self.seed, F.col("s"), epoch)
        return final.select("shard", F.pmod("id", F.lit(shard_slots)).alias("slot"), "s", epoch.alias("epoch"), block.alias("block"))

    def pieces(self) -> DataFrame:
        """Documents by block, with each slot that takes it: epoch, lo and hi (words of the document); a
        document that no slot takes has one row with a null epoch."""
        n = self.block
        last = F.expr(f"(start + size - 1) div {n}")
        spread = self.documents.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {n}"), last))))
        parts = spread.join(self.slots.select("s", "block", "epoch", "shard"), ["s", "block"], "left")
        lo, hi = F.greatest(F.col("block") * n - F.col("start"), F.lit(0)), F.least((F.col("block") + 1) * n - F.col("start"), F.col("size"))
        return parts.withColumns({"lo": lo, "hi": hi})


def mix_counts(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, source, size (words), source_size, target (of its source) and taken, the words
    that the mix takes from it, repeats counted.

    Null texts have size 0; a null source is a source of its own, the last; null ids and repeated rows
    are documents like others; an empty table gives an empty result.  Extra columns are not read.
    """
    parts = Mix(docs, id_col=id_col, **options).pieces()
    taken = F.sum(F.when(F.col("epoch").isNotNull(), F.col("hi") - F.col("lo")).otherwise(0))
    out = parts.groupBy("s", "bucket", "n", "id", "source", "size", "source_size", "target").agg(taken.alias("taken"))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = None, **options) -> DataFrame:
    """The mixed corpus, in the input's columns: a row per document and pass that takes words of it, with the
    text whole where all its words are taken, else the parts of the text that are taken, with the white space in front of
    each but the first.  Equal rows are told from rows that differ in any column.

    ``length_col`` names a column to set to the new text's length.  Documents taken in no pass don't
    appear.  Nulls as in ``mix_counts``.
    """
    mix = Mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, row=row_hash(docs), **options)
    parts = mix.pieces().where("epoch is not null")
    passes = parts.groupBy("id", "r", "source", "s", "bucket", "n", "epoch", "size").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"), F.sum(F.col("hi") - F.col("lo")).alias("words"))
    taken = passes.groupBy("id", "r", "source").agg(F.collect_list(F.struct("bucket", "n", "epoch", "size", "words", "ranges")).alias("passes"))
    key = [P + "id", P + "r", P + "source"]
    rows = docs.select(as_row(docs), F.col(id_col).alias(key[0]), row_hash(docs).alias(key[1]), F.col(source_col).alias(key[2]))
    rows = rows.groupBy(*key).agg(F.first(P + "row").alias(P + "row"))  # equal rows
    on = rows[key[0]].eqNullSafe(taken["id"]) & (rows[key[1]] == taken["r"]) & rows[key[2]].eqNullSafe(taken["source"])
    rows = rows.join(taken, on).select(P + "row", F.explode("passes").alias(P + "pass"))
    text, got = F.col(P + "row").getField(text_col), F.col(P + "pass")
    # a word with the white space before it; what a slot takes is cut from the text as it stands
    words = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    rows = rows.withColumn(P + "words", F.when(got["words"] < got["size"], words))
    cut = lambda r: F.array_join(F.slice(F.col(P + "words"), (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")), "")
    part = F.array_join(F.transform(got["ranges"], lambda r, i: F.when(i == 0, F.btrim(cut(r), F.lit(WHITE))).otherwise(cut(r))), "")
    new = F.when(got["words"] == got["size"], text).otherwise(part)
    rows = rows.withColumn(P + "text", new)
    swap = {text_col: F.col(P + "text")} | ({length_col: F.length(P + "text").cast(docs.schema[length_col].dataType)} if length_col in docs.columns else {})
    return rows.select(*((swap[c] if c in swap else F.col(P + "row").getField(c)).alias(c) for c in docs.columns))
