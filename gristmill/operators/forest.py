"""Walks in forests of any depth by pointer doubling: as many rounds as the logarithm of the longest path.

A forest is a table of nodes with their parents, in groups (documents).  A root has a null parent, itself, or one that isn't there.
Groups of up to ``IN_ONE`` nodes are walked within a task, many at a time, after one shuffle.  A larger one may be of any size:
its rows are dealt by group and node, a round is a self-join, and every round is staged, which cuts lineage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch


#: Nodes of a group that one task may hold, and of groups that are walked together.
IN_ONE, TOGETHER = 1 << 16, 1 << 17


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _start(nodes: DataFrame, keys: Sequence[str], node: str, parent: Column, values: Mapping[str, Column]) -> DataFrame:
    """__k0.., __node, __up (null at roots) and values of each node."""
    return _staged(_linked(nodes, keys, node, parent, values), "forest")


def _linked(nodes: DataFrame, keys: Sequence[str], node: str, parent: Column, values: Mapping[str, Column]) -> DataFrame:
    mine = nodes.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(node).alias("__node"), parent.alias("__up"), *(v.alias(f"__v_{n}") for n, v in values.items()))
    return mine.withColumn("__up", F.when(F.col("__up") != F.col("__node"), F.col("__up")))


def _positions(table: pa.Table) -> np.ndarray:
    """The row of each row's parent in its group, -1 for none."""
    group = np.zeros(table.num_rows, "int64")
    for name in table.column_names:
        if name.startswith("__k"):
            codes = table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype("int64")
            group = np.unique(group * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
    both = pa.concat_arrays([table["__node"].combine_chunks(), table["__up"].combine_chunks().cast(table["__node"].type)]).dictionary_encode()
    codes = both.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")
    node, up = np.split(codes, 2)
    wide = max(len(both.dictionary), 1)
    place, asked = group * wide + node, group * wide + up
    order = np.argsort(place, kind="stable")
    at = np.minimum(np.searchsorted(place[order], asked), max(len(order) - 1, 0))
    found = order[at] if len(order) else at
    return np.where((up >= 0) & (place[found] == asked), found, -1)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)


def _climbed(table: pa.Table) -> pa.Table:
    up = _positions(table)
    above = np.where(up < 0, np.arange(len(up)), up)
    sums = {n: np.where(up < 0, 0, _numbers(table, n)[above]) for n in table.column_names if n.startswith("__v_")}
    for _ in range(len(up).bit_length() + 1):
        sums = {n: s + s[above] for n, s in sums.items()}
        above = above[above]
    if (up[above] >= 0).any():
        raise ValueError("a node is its own ancestor")
    kept = {n: table[n] for n in table.column_names if n.startswith("__k")}
    return pa.table({**kept, "__node": table["__node"], "__root": table["__node"].combine_chunks().take(pa.array(above)), **sums})


def _summed(table: pa.Table) -> pa.Table:
    up, s = _positions(table), _numbers(table, "__v_s").copy()
    for _ in range(len(up).bit_length() + 2):
        live = np.flatnonzero(up >= 0)
        if not len(live):
            kept = {n: table[n] for n in table.column_names if n.startswith("__k")}
            return pa.table({**kept, "__node": table["__node"], "__v_s": s})
        more = s.copy()
        np.add.at(more, up[live], s[live])
        s, up = more, np.where(up >= 0, up[up], -1)
    raise ValueError("a node is its own ancestor")


def _in_tasks(mine: DataFrame, names: Sequence[str], walk, out: Sequence[str], whole: int) -> DataFrame:
    """``walk`` over bundles of groups; sums are long or double."""
    wide = lambda c: "double" if mine.schema[c].dataType.simpleString() in ("double", "float") else "bigint"
    kinds = {f.name: f.dataType.simpleString() for f in mine.schema} | {"__root": mine.schema["__node"].dataType.simpleString()}
    values = [c for c in mine.columns if c.startswith("__v_")]
    mine = mine.withColumns({c: F.col(c).cast(wide(c)) for c in values})
    schema = ", ".join(f"{c} {wide(c) if c in values else kinds[c]}" for c in out)
    bundle = F.pmod(F.xxhash64(*names) if names else F.lit(0), F.lit(max(1, whole // TOGETHER))).alias("__bundle")
    return mine.groupBy(bundle).applyInArrow(lambda table: walk(table).select(list(out)), schema)


def _without_cycles(walked: DataFrame, safe: bool) -> DataFrame:
    """A cycle is an error here, not later: unless links of one direction rule it out, the walk is done now, and staged."""
    if safe:
        return walked
    try:
        return _staged(walked, "forest")
    except PySparkException as e:
        if "a node is its own ancestor" in str(e):
            raise ValueError("a node is its own ancestor") from e
        raise


def _by_size(nodes: DataFrame, keys: Sequence[str], node: str, parent: Column) -> tuple[DataFrame, DataFrame | None, int, bool]:
    """Nodes of small groups, those of large ones if there are any, the number of nodes, and whether all links lead the same way."""
    ways = [F.coalesce(F.bool_or(w), F.lit(False)) for w in (parent < F.col(node), parent > F.col(node))]
    sizes = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"), ways[0].alias("__less"), ways[1].alias("__more"))
    whole, most, less, more = sizes.agg(F.sum("__size"), F.max("__size"), F.bool_or("__less"), F.bool_or("__more")).first()
    safe = not (less and more)
    if not most or most <= IN_ONE:
        return nodes, None, whole or 0, safe
    large = sizes.where(F.col("__size") > IN_ONE).select(*(F.col(k).alias(f"__large{i}") for i, k in enumerate(keys)))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__large{i}"))
    return nodes.join(large, on, "left_anti"), nodes.join(large, on, "left_semi"), whole, safe


def _above(state: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The state under other names, to be joined as the nodes that ``__up`` points to."""
    names = [c for c in state.columns if c.startswith("__k")]
    return state.select(*(F.col(c).alias(f"{c}_") for c in (*names, "__node", *columns))), names


def _joined(state: DataFrame, above: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    on = state["__up"] == above["__node_"]
    for c in names:
        on = on & state[c].eqNullSafe(above[f"{c}_"])
    return state.join(above, on, how)


def climb(nodes: DataFrame, keys: Sequence[str], node: str, parent: Column, values: Mapping[str, Column] | None = None) -> DataFrame:
    """keys, node, root, depth, and for each of ``values`` its sum over the node's proper ancestors.  Nodes are distinct in their
    group; a cycle is an error."""
    values = {"depth": F.lit(1).cast("long"), **(values or {})}
    small, large, whole, safe = _by_size(nodes, keys, node, parent)
    mine, sums, names = _linked(small, keys, node, parent, values), [f"__v_{n}" for n in values], [f"__k{i}" for i in range(len(keys))]
    walked = _without_cycles(_in_tasks(mine, names, _climbed, [*names, "__node", "__root", *sums], whole), safe)
    named = walked.select(*(F.col(c).alias(k) for c, k in zip(names, keys)), F.col("__node").alias(node), F.col("__root").alias("root"), *(F.col(s).alias(n) for s, n in zip(sums, values)))
    return named if large is None else named.unionByName(_climb_by_joins(large, keys, node, parent, values))


def _climb_by_joins(nodes: DataFrame, keys: Sequence[str], node: str, parent: Column, values: Mapping[str, Column]) -> DataFrame:
    start = _start(nodes, keys, node, parent, values)
    sums = [f"__v_{n}" for n in values]
    above, names = _above(start, sums)
    state = _joined(start, above, names, "left").select(
        *names, "__node", F.col("__node_").alias("__up"), F.coalesce("__node_", "__node").alias("__root"), *(F.coalesce(f"{s}_", F.lit(0)).alias(s) for s in sums)
    )
    state = _staged(state, "forest")
    for _ in range(start.count().bit_length() + 1):
        if state.where("__up IS NOT NULL").isEmpty():
            return state.select(*(F.col(c).alias(k) for c, k in zip(names, keys)), F.col("__node").alias(node), F.col("__root").alias("root"), *(F.col(s).alias(n) for s, n in zip(sums, values)))
        above, _ = _above(state, ["__up", "__root", *sums])
        state = _joined(state, above, names, "left").select(
            *names, "__node", F.col("__up_").alias("__up"), F.coalesce("__root_", "__root").alias("__root"), *((F.col(s) + F.coalesce(f"{s}_", F.lit(0))).alias(s) for s in sums)
        )
        state = _staged(state, "forest")
    raise ValueError("a node is its own ancestor")


def subtree_sums(nodes: DataFrame, keys: Sequence[str], node: str, parent: Column, value: Column, out: str) -> DataFrame:
    """keys, node and the sum of ``value`` over the node and all below it.  In each round a node adds what the nodes
    that point to it have summed so far, and each then points twice as far."""
    small, large, whole, safe = _by_size(nodes, keys, node, parent)
    names = [f"__k{i}" for i in range(len(keys))]
    walked = _without_cycles(_in_tasks(_linked(small, keys, node, parent, {"s": value}), names, _summed, [*names, "__node", "__v_s"], whole), safe)
    named = walked.select(*(F.col(c).alias(k) for c, k in zip(names, keys)), F.col("__node").alias(node), F.col("__v_s").alias(out))
    return named if large is None else named.unionByName(_sums_by_joins(large, keys, node, parent, value, out))


def _sums_by_joins(nodes: DataFrame, keys: Sequence[str], node: str, parent: Column, value: Column, out: str) -> DataFrame:
    state = _start(nodes, keys, node, parent, {"s": value})
    for _ in range(state.count().bit_length() + 2):
        if state.where("__up IS NOT NULL").isEmpty():
            names = [c for c in state.columns if c.startswith("__k")]
            return state.select(*(F.col(c).alias(k) for c, k in zip(names, keys)), F.col("__node").alias(node), F.col("__v_s").alias(out))
        above, names = _above(state, ["__up"])
        given = state.where("__up IS NOT NULL").groupBy(*(F.col(c).alias(f"{c}_g") for c in names), F.col("__up").alias("__to")).agg(F.sum("__v_s").alias("__more"))
        on = state["__node"] == given["__to"]
        for c in names:
            on = on & state[c].eqNullSafe(given[f"{c}_g"])
        more = state.join(given, on, "left").select(*names, "__node", "__up", (F.col("__v_s") + F.coalesce("__more", F.lit(0))).alias("__v_s"))
        state = _staged(_joined(more, above, names, "left").select(*names, "__node", F.col("__up_").alias("__up"), "__v_s"), "forest")
    raise ValueError("a node is its own ancestor")


def token_walks(tokens: DataFrame, clause: Sequence[str]) -> DataFrame:
    """Per token of a parse (doc_id, sent_id, i, head_i, dep, is_space): depth, clause heads above it (the root never counts),
    prepositions right above it one after the other, the conjunct chain's first token, and the words of its subtree in its sentence."""
    keys = ["doc_id"]
    dep, inner = F.coalesce("dep", F.lit("")), F.col("head_i") != F.col("i")
    count = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    depth = climb(tokens, keys, "i", F.col("head_i"), {"nesting": count(dep.isin(*clause) & inner)}).select("doc_id", "i", "depth", "nesting")
    heads = tokens.select(F.col("doc_id").alias("__d"), F.col("i").alias("__i"), F.col("sent_id").alias("__sent"), (F.coalesce(F.col("dep"), F.lit("")) == "prep").alias("__prep"), (F.col("head_i") == F.col("i")).alias("__root"))
    linked = tokens.join(heads, tokens["doc_id"].eqNullSafe(heads["__d"]) & (tokens["head_i"] == heads["__i"]), "left")
    preps = climb(linked, keys, "i", F.when(F.col("__prep") & ~F.col("__root"), F.col("head_i"))).select("doc_id", "i", F.col("depth").alias("prep_run"))
    chains = climb(tokens, keys, "i", F.when((dep == "conj") & inner, F.col("head_i"))).select("doc_id", "i", F.col("root").alias("chain"))
    sizes = subtree_sums(linked, keys, "i", F.when(F.col("__sent") == F.col("sent_id"), F.col("head_i")), count(~F.coalesce("is_space", F.lit(False))), "words_below")
    out = tokens.select("doc_id", "i")
    for part in (depth, preps, chains, sizes):
        named = part.select(F.col("doc_id").alias("__d"), F.col("i").alias("__i"), *(c for c in part.columns if c not in ("doc_id", "i")))
        out = out.join(named, out["doc_id"].eqNullSafe(named["__d"]) & (out["i"] == named["__i"])).drop("__d", "__i")
    return out
