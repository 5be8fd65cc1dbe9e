"""Prefix trie of conversations: which turns conversations share from their start, and what sharing them saves.

A node is a sequence of first turns; its id is 128 bits, sums of hashes of (place, role, text) along it, so that
prefix sums by blocks give all ids, however long a conversation.  Nodes with at most a limit of rows in and below them
are light: each topmost light node is the root of a subtrie that lies in one prefix shard.  A shard is a succinct
level-order trie (LOUDS): one bit a child, a zero a node, and an array of labels; its roll-ups go over the levels
backwards by ``add.at``.  The heavy nodes above, of which any can have any number of members, are merged by
aggregations: each distinct node below charges its sums to the path of one of its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import with_rank
from .common import keep_caches_of, staged

#: Rows of a subtrie at least and at most, and rows of a shard on average at most.
LEAST_LIGHT, MOST_LIGHT = 64, 65_536
#: Places of a conversation that are summed in one window, as a power of two; ids of members in one string, likewise.
BLOCK, BAND = 12, 16
NODE = ["pos", "p1", "p2"]
NODES = "pos long, p1 long, p2 long, q1 long, q2 long, least long, parent long, n long, children long, leaves long, saved long, top boolean"
NOBODY = np.iinfo(np.int64).max
MASK = 0xFFFFFFFF


class Louds:
    """A forest in level order below one super-root: ``bits`` has for each node, level by level, a one a child and a zero;
    ``labels`` names the node of each one.  Nodes are numbered by their ones; ``order`` has their input rows."""

    def __init__(self, pos: np.ndarray, ids: np.ndarray, parents: np.ndarray, tops: np.ndarray) -> None:
        """``ids`` and ``parents`` (n x 2) name nodes at depth ``pos`` and their parents one above; ``tops`` is the depth of
        each node's topmost ancestor here."""
        n = len(pos)
        named = lambda d, x: np.ascontiguousarray(np.column_stack([d, x])).view("V24").ravel()
        keys, wanted = named(pos, ids), named(pos - 1, parents)
        by_key = np.argsort(keys)
        level = pos - tops
        up = np.full(n, -1)
        inner = np.flatnonzero(level > 0)
        up[inner] = by_key[np.minimum(np.searchsorted(keys[by_key], wanted[inner]), max(n - 1, 0))]
        if (keys[up[inner]] != wanted[inner]).any():
            raise ValueError("a node without its parent")
        rank = np.zeros(n, np.int64)
        by_level = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[by_level], np.arange(int(level.max(initial=-1)) + 2))
        self.order = np.zeros(n, np.int64)
        for a, b in zip(bounds, bounds[1:]):
            rows = by_level[a:b]
            above = rank[up[rows]] if a else np.zeros(len(rows), np.int64)
            rows = rows[np.lexsort((ids[rows, 1], ids[rows, 0], pos[rows], above))]
            self.order[a:b], rank[rows] = rows, np.arange(a, b)
        self.levels = list(zip(bounds, bounds[1:]))
        mine = up[self.order]
        degree = np.bincount(np.where(mine < 0, 0, rank[mine] + 1), minlength=n + 1)
        self.zeros = np.cumsum(degree) + np.arange(n + 1)
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[self.zeros] = False
        self.labels = ids[self.order]

    def parents(self) -> np.ndarray:
        """The parent of each node, -1 below the super-root: zeros before the node's one, less one."""
        return np.cumsum(~self.bits)[self.bits] - 1

    def children(self) -> np.ndarray:
        """How many children each node has: the ones between its zero and the zero before."""
        return np.diff(self.zeros) - 1

    def rolled_up(self, values: np.ndarray, by=np.add) -> np.ndarray:
        """Values of each node and all below it, from the deepest level up."""
        out, parents = values.copy(), self.parents()
        for a, b in reversed(self.levels[1:]):
            by.at(out, parents[a:b], out[a:b])
        return out


def _shard(table: pa.Table) -> pa.Table:
    keep_caches_of("trie")
    c = {n: table.column(n).to_numpy() for n in ("pos", "p1", "p2", "q1", "q2", "top_pos", "words", "ends")}
    trie = Louds(c["pos"], np.column_stack([c["p1"], c["p2"]]), np.column_stack([c["q1"], c["q2"]]), c["top_pos"])
    at = trie.order
    n = trie.rolled_up(c["ends"][at])
    least = trie.rolled_up(table.column("first_end").fill_null(NOBODY).to_numpy()[at], np.minimum)
    kids, parents = trie.children(), trie.parents()
    leaves, saved = trie.rolled_up((kids == 0).astype(np.int64)), trie.rolled_up((n - 1) * c["words"][at])
    top = parents < 0
    parent = pa.array(np.where(top, 0, least[parents]), pa.int64(), mask=top)
    made = {x: c[x][at] for x in ("pos", "p1", "p2", "q1", "q2")} | {"least": least, "parent": parent, "n": n, "children": kids, "leaves": leaves, "saved": saved, "top": top}
    return pa.table({k: pa.array(v) for k, v in made.items()})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the parts of each node, which come one after the other in order."""
    keep_caches_of("trie")
    key, digest = None, None
    for batch in batches:
        done = []
        for row in zip(*(batch.column(c).to_pylist() for c in (*NODE, "part"))):
            if row[:3] == key:
                digest.update(b"," + row[3].encode())
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = row[:3], hashlib.sha256(row[3].encode())
        yield _digest_rows(done)
    if key is not None:
        yield _digest_rows([(*key, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*NODE, "ends_sha256"])


def shared_starts(c: Column) -> Column:
    """How many first turns a conversation takes from the one its prompt was copied from: crc32 of its decimal id, mod 4."""
    return F.crc32(c.cast("string").cast("binary")) % 4


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, n, len, a, b, words) to rebuilt ones (c, pos, L, a, b, words), and conversations (c, L)."""
    lens = turns.groupBy("c").agg(F.max("len").alias("len"))
    convs = lens.select("c", "len", shared_starts(F.col("c")).alias("h"), (F.col("c") - F.col("c") % 20).alias("base"))
    of_base = lens.where("c % 20 = 0").select(F.col("c").alias("base"), F.col("len").alias("base_len"))
    convs = convs.join(of_base, "base", "left").withColumn("m", F.least("h", F.coalesce("base_len", F.lit(0))))
    convs = staged(convs.select("c", "base", "h", "m", (F.col("m") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("L")), "conversations")
    starts = turns.where("c % 20 = 0 AND n <= 3").select(F.col("c").alias("base"), "n", "a", "b", "words")
    taken = convs.join(starts, "base").where("n <= h").select("c", F.col("n").alias("pos"), "L", "a", "b", "words")
    own = turns.join(convs, "c").where("n > h").select("c", (F.col("n") - F.col("h") + F.col("m")).alias("pos"), "L", "a", "b", "words")
    return taken.unionByName(own), convs.select("c", "L")


def _sums(rows: DataFrame, values: list[str], down: bool) -> DataFrame:
    """Adds ``up_<value>``: sums along each conversation (c) up to each place (pos), or down to it.  A long conversation is
    summed in blocks of places, and the blocks' sums once more."""
    block, way = F.shiftright("pos", BLOCK), (lambda c: F.desc(c) if down else F.asc(c))
    rows = rows.withColumn("block", block)
    inside = Window.partitionBy("c", "block").orderBy(way("pos")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("b_c").orderBy(way("b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    sums = rows.groupBy(F.col("c").alias("b_c"), F.col("block").alias("b")).agg(*(F.sum(v).alias(v) for v in values))
    sums = sums.select("b_c", "b", *(F.sum(v).over(before).alias(f"before_{v}") for v in values)).where(F.col(f"before_{values[0]}").isNotNull())
    rows = rows.withColumns({f"up_{v}": F.sum(v).over(inside) for v in values}).join(sums, (F.col("c") == F.col("b_c")) & (F.col("block") == F.col("b")), "left")
    return rows.withColumns({f"up_{v}": F.col(f"up_{v}") + F.coalesce(f"before_{v}", F.lit(0)) for v in values}).drop("b_c", "b", "block", *(f"before_{v}" for v in values))


def _paths(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and depth, 0 too: the node's id p1, p2, its parent's q1, q2, words of its last text, L."""
    hashes = [F.xxhash64(F.lit(seed), "a", "b", "pos") for seed in (21, 22)]
    lanes = {f"l{i}": F.shiftrightunsigned(hashes[i // 2], 32 * (i % 2)).bitwiseAND(F.lit(MASK)) for i in range(4)}
    rows = rebuilt.select("c", "pos", "L", "words", *(x.alias(n) for n, x in lanes.items()))
    sums = _sums(rows, [*lanes], False)
    half = lambda x: x.bitwiseAND(F.lit(MASK))
    both = lambda f, i: half(f(i)).bitwiseOR(F.shiftleft(half(f(i + 1)), 32))
    upto, before = (lambda i: F.col(f"up_l{i}")), (lambda i: F.col(f"up_l{i}") - F.col(f"l{i}"))
    ids = [both(upto, 0).alias("p1"), both(upto, 2).alias("p2"), both(before, 0).alias("q1"), both(before, 2).alias("q2")]
    zero = F.lit(0).cast("long")
    roots = convs.select("c", zero.alias("pos"), "L", zero.alias("words"), *(zero.alias(x) for x in ("p1", "p2", "q1", "q2")))
    return sums.select("c", F.col("pos").cast("long").alias("pos"), F.col("L").cast("long").alias("L"), F.col("words").cast("long").alias("words"), *ids).unionByName(roots)


def _parent_of(least: str, nodes: DataFrame) -> DataFrame:
    """Heavy nodes as parents: key columns of their children and their least member."""
    return nodes.select((F.col("pos") + 1).alias("pos"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("least").alias(least))


def prefix_nodes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", light: int | None = None) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    A conversation's turns go by ``turn_col``, nulls first, equal turns by a hash of role and text, so that repeated rows
    count and results don't depend on their order; its first ``shared_starts`` turns are replaced by those of the
    conversation c - c % 20, if that exists.  Null roles and texts are empty; rows without a conversation take no part;
    other columns are ignored, whatever their names; an empty table has no nodes.  ``light`` is the most rows in and below a node
    whose subtrie lies in one shard; by default it follows the number of rows a task gets.
    """
    spark = conversations.sparkSession
    part = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.regexp_count(own[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = conversations.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("c"), F.col(f"`{turn_col}`").alias("turn"), *(F.xxhash64(F.lit(seed), *own).alias(x) for x, seed in (("a", 11), ("b", 12))), words.alias("words")
    )
    turns = staged(turns, "turns")
    turns = staged(with_rank(turns, ["c"], ["turn", "a", "b"], "n", "len").drop("turn"), "numbered_turns")
    rows = staged(_paths(*_rebuilt(turns)), "paths")
    size = rows.count()
    limit = light or min(max(size // (2 * part), LEAST_LIGHT), MOST_LIGHT)

    ends = F.col("pos") == F.col("L")
    heavy = rows.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.sum(F.col("L") - F.col("pos") + 1).alias("below"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("words").alias("words")
    )
    heavy = staged(heavy.where(F.col("below") > limit).drop("below"), "heavy_nodes")
    # light rows of a conversation are at most ``limit``: all lie below its topmost light node
    down = Window.partitionBy("c").orderBy("pos")
    lower = rows.join(heavy.select(*NODE), NODE, "left_anti")
    lower = lower.withColumns({f"top_{x}": F.first(x).over(down) for x in NODE})
    lower = lower.groupBy(*NODE, *(f"top_{x}" for x in NODE)).agg(F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("words").alias("words"), F.sum(ends.cast("long")).alias("ends"), F.min(F.when(ends, F.col("c"))).alias("first_end"))
    shards = max(2 * part, size // MOST_LIGHT)
    dealt = lower.withColumn("shard", F.pmod(F.xxhash64(*(f"top_{x}" for x in NODE)), F.lit(shards)))
    nodes = staged(dealt.groupBy("shard").applyInArrow(_shard, NODES), "light_nodes")

    tops = nodes.where("top")
    kids = heavy.where("pos > 0").select("pos", "q1", "q2").union(tops.where("pos > 0").select("pos", "q1", "q2"))
    kids = kids.groupBy((F.col("pos") - 1).alias("pos"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("children"))
    heavy = staged(heavy.join(kids, NODE, "left").na.fill(0, ["children"]), "heavy_nodes")
    # what each node adds to all above it goes to the path of its least member
    charges = heavy.select(F.col("least").alias("c"), "pos", (F.col("children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    charges = staged(charges.unionByName(tops.select(F.col("least").alias("c"), "pos", "leaves", "saved")), "charges")
    path = rows.join(heavy.select(*NODE), NODE, "left_semi").join(charges.select("c").distinct(), "c", "left_semi")
    none = F.lit(None).cast("long")
    both = path.select("c", *NODE, F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")).unionByName(charges.select("c", "pos", none.alias("p1"), none.alias("p2"), "leaves", "saved"))
    both = staged(both.groupBy("c", "pos").agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "charged_paths")
    totals = _sums(both, ["leaves", "saved"], True).where("p1 IS NOT NULL").groupBy(*NODE).agg(F.sum("up_leaves").alias("leaves"), F.sum("up_saved").alias("saved"))

    columns = [*NODE, "least", "parent", "n", "children", "leaves", "saved"]
    upper = heavy.join(totals, NODE).join(_parent_of("parent", heavy), ["pos", "q1", "q2"], "left").select(*columns)
    lower = nodes.where("NOT top").select(*columns).unionByName(tops.drop("parent").join(_parent_of("parent", heavy), ["pos", "q1", "q2"], "left").select(*columns))

    # a conversation ends once, so a band of ids has a bounded number of ends
    parts = rows.where(ends).groupBy(*NODE, F.shiftright("c", BAND).alias("band")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string"))).alias("part"))
    parts = parts.repartition(part, *NODE).sortWithinPartitions(*NODE, "band").select(*NODE, "part")
    digests = parts.mapInArrow(_digests, "pos long, p1 long, p2 long, ends_sha256 string")
    out = upper.unionByName(lower).join(digests, NODE, "left")
    return out.select(
        F.col("least").alias("conv_id"), F.col("pos").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
