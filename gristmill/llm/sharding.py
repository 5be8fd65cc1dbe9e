"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

A tree is an append-only log of layers.  A layer holds regions, these racks, these shards, each with the weight
that the layer adds to it.  A key descends: at each level it draws ``-ln(u(key, node)) / weight`` for
each node open to it, an exponential variate, and takes the node of the least draw, so it falls to nodes in
proportion to their weights.  At the top the nodes of all layers are open; below, those of the node taken.
Only nodes on the way down are drawn for: about regions + racks + shards of one rack, not all shards.

More weight is a new layer: its one region, rack and shard.  A key moves if and only if the new layer's draw is
the least at the top, and then descends to that shard, so nothing moves but into the shard that grew.  A
weight changed within a layer changes draws of the nodes on its path alone; keys move from or to these subtrees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, numbered, staged, with_outputs

#: A layer: regions, each a list of racks, each a list of (shard id, weight added).
Layer = Sequence[Sequence[Sequence[tuple[int, float]]]]
Tree = Sequence[Layer]


def layout(shards: int, per_rack: int = 4, racks: int = 4, weight: float = 1.0) -> Tree:
    """Shards 0 to ``shards``-1 in racks of ``per_rack`` and regions of ``racks``, built at once."""
    leaves = [(i, weight) for i in range(shards)]
    full = [leaves[i : i + per_rack] for i in range(0, shards, per_rack)]
    return [[full[i : i + racks] for i in range(0, len(full), racks)]]


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree after ``weight`` is added to a shard, new or known."""
    return [*tree, [[[(shard, weight)]]]]


def _numbered_nodes(tree: Tree) -> tuple[list[tuple], list[list[tuple]], list[list[tuple]]]:
    """Regions, racks by region and shards by rack, as (number, weight, place of its children or shard id).

    Numbers stay as layers are appended; nodes without weight get a number and are never open."""
    regions, racks, shards, at = [], [], [], 0
    for layer in tree:
        for region in layer:
            own, at = at, at + 1
            racks.append([])
            for rack in region:
                mine, at = at, at + 1
                shards.append([])
                for shard, weight in rack:
                    if weight > 0:
                        shards[-1].append((at, float(weight), shard))
                    at += 1
                total = sum(w for _, w, _ in shards[-1])
                if total:
                    racks[-1].append((mine, total, len(shards) - 1))
            total = sum(w for _, w, _ in racks[-1])
            if total:
                regions.append((own, total, len(racks) - 1))
    return regions, racks, shards


def place(key: Column, tree: Tree, seed: int = 7) -> Column:
    """The shard that ``key`` descends to; a null key is one key like any other, a tree without weight gives null."""
    regions, racks, shards = _numbered_nodes(tree)
    if not regions:
        return F.lit(None).cast("int")

    def nodes(level: list[tuple]) -> Column:
        kind = "array<struct<node:int,weight:double,to:int>>"
        return F.array(*(F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight"), F.lit(to).alias("to")) for n, w, to in level)).cast(kind)

    def least(level: Column) -> Column:
        def draw(n: Column) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), n["node"], key), 11).cast("double") + 0.5) * F.lit(2.0**-53)
            return F.struct((-F.log(u) / n["weight"]).alias("draw"), n["to"].alias("to"))

        return F.array_min(F.transform(level, draw))["to"]

    taken = least(nodes(regions))
    for level in (racks, shards):
        taken = least(F.element_at(F.array(*map(nodes, level)), taken + 1))
    return taken


def shard_documents(docs: DataFrame, tree: Tree, more: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """Adds to each row: size (UTF-8 bytes and 16; null text: 16), text_crc32 (null text: that of no bytes), shard, slot and, with ``more``,
    a grown tree, grown_shard.

    Slots are gapless from 0 in each shard, in an order fixed by hash bucket and id.  Null ids share one
    shard, equal ids too; equal rows get slots of their own.  An empty table gives an empty result.
    Output columns replace input columns of the same name.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    work = docs.select(
        F.col(id_col).alias(P + "id"), (F.octet_length(raw) + 16).cast("long").alias(P + "size"), F.crc32(raw).alias(P + "crc"),
        place(F.col(id_col), tree, seed).alias(P + "shard"), (place(F.col(id_col), more, seed) if more else F.lit(None).cast("int")).alias(P + "grown"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias(P + "row"),
        F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias(P + "deal"),  # spreads equal rows; staged, so it stays
    )
    work = staged(work, "shards")
    done = numbered(work, [P + "shard"], [P + "id", P + "crc", P + "size"], P + "slot", deal=P + "deal")
    names = {"size": P + "size", "text_crc32": P + "crc", "shard": P + "shard", "slot": P + "slot"} | ({"grown_shard": P + "grown"} if more else {})
    return with_outputs(done, P + "row", {k: F.col(v) for k, v in names.items()})
