"""Exact top-k by inner product over integer vectors, pruned by norms and by partial sums.

Vectors are sorted by descending length and cut into blocks; query blocks meet candidate blocks on a grid
whose cells stream their blocks from the longest vectors down.  Thresholds start from the block of the longest
vectors; a candidate block is sent only to query blocks of which a query's bound |q| * (block's greatest length)
reaches its threshold, and is skipped for queries whose bound is below their k-th score by then.  Inside a block, coordinates are rotated by the
right singular vectors of all vectors, so that few leading ones hold most of a product; the rest is
bounded by Cauchy-Schwarz, and only pairs whose partial sum and bound reach the threshold are computed
in full, from the integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, tasks_for

BLOCKS = "kind int, block long, top double, n int, ids binary, cells binary, held string"
HITS = "qblock int, pos int, query_id long, vec_id long, score long"
EXACT = 2.0**53


def _floor(x: Column) -> Column:
    """Floor as a double; doubles of this size and more are whole already."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def _scores(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Products of integer rows; beyond what doubles hold exactly, by Python's integers, limited to 64 bits."""
    if bound < EXACT:
        return q @ c.T
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(exact, -(2**63), 2**63 - 1)


class _Best:
    """The k best of each query of a block: highest score, then smallest id."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, k: int, turn: np.ndarray, lead: int, floor: np.ndarray | None = None) -> None:
        self.ids, self.cells, self.k, self.turn, self.lead = ids, cells, k, turn, lead
        self.norms = np.sqrt((cells**2).sum(1))
        self.turned = cells @ turn
        self.rest = np.sqrt(np.maximum((self.turned[:, lead:] ** 2).sum(1), 0))
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.found: list[list[tuple]] = [[] for _ in ids]
        self.slack = 1e-9 * (self.norms + 1)

    def add(self, ids: np.ndarray, cells: np.ndarray, top: float) -> None:
        live = np.flatnonzero(self.norms * top * (1 + 1e-9) >= self.floor)
        if not len(live) or not len(ids):
            return
        norms = np.sqrt((cells**2).sum(1))
        turned = cells @ self.turn
        rest = np.sqrt((turned[:, self.lead :] ** 2).sum(1))
        partial = self.turned[live, : self.lead] @ turned[:, : self.lead].T
        partial += self.rest[live, None] * rest[None]
        partial += self.slack[live, None] * (norms[None] + 1)
        maybe = partial >= self.floor[live, None]
        bound = float(self.norms.max() * norms.max()) * 1.01
        if bound >= EXACT or maybe.mean() > 0.02:
            scores = _scores(self.cells[live], cells, bound)
            maybe &= (scores >= self.floor[live, None]).astype(bool)
            rows, cols = np.nonzero(maybe)
            scores = scores[rows, cols]
        else:
            rows, cols = np.nonzero(maybe)
            scores = np.einsum("ij,ij->i", self.cells[live[rows]], cells[cols])
        own = self.ids[live[rows]] != ids[cols]
        rows, cols, scores = rows[own], cols[own], scores[own]
        order = np.lexsort((ids[cols], -scores, rows)) if scores.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], ids[cols[i]])), int)
        rows, cols, scores = rows[order], cols[order], scores[order]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(rows)]):
            q, hi = int(live[rows[lo]]), min(int(hi), int(lo) + self.k)
            best = sorted([*self.found[q], *((-int(s), int(i)) for s, i in zip(scores[lo:hi], ids[cols[lo:hi]]))])[: self.k]
            self.found[q] = best
            if len(best) == self.k:
                self.floor[q] = max(self.floor[q], -best[-1][0])

    def hits(self, block: int) -> Iterator[tuple]:
        for pos, best in enumerate(self.found):
            for s, i in best:
                yield block, pos, int(self.ids[pos]), i, -s


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["qblock", "pos", "query_id", "vec_id", "score"])


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096, query_block: int = 1024, lead: float = 0.4) -> DataFrame:
    """For each row that ``is_query`` holds for, the ``k`` rows of the highest inner product of
    floor(scale * component), ties to the smaller id: query_id, rank, vec_id, score.

    All rows but those of the query's own id are candidates.  Rows with a null id, a null vector or a
    null or non-finite component take no part; shorter vectors are padded by zeros.  Repeated rows count
    each.  Scores beyond 64 bits are limited to them.  Extra columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: F.coalesce(bad(x), F.lit(True))))
    good = good.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: _floor(x.cast("double") * scale)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    good = staged(good.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "vectors")
    dims = good.agg(F.max(F.size("v"))).first()[0] or 1

    def padded(column: pa.Array) -> np.ndarray:
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if (sizes == dims).all():
            return flat.reshape(-1, dims)
        out = np.zeros((len(sizes), dims))
        out[np.arange(dims)[None] < sizes[:, None]] = flat
        return out

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            m = padded(batch.column(0))
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    # dims x dims sums, whatever the number of vectors
    sums = good.select("v").mapInArrow(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    whole = np.zeros((dims, dims))
    for r in sums:
        whole[r.i, r.j] = r.x
    turn = np.linalg.svd(whole)[0] if np.isfinite(whole).all() else np.eye(dims)
    ahead = max(1, int(dims * lead))
    n = tasks_for(good)

    def blocks_of(rows: DataFrame, kind: int, size: int) -> DataFrame:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, cells = np.zeros(0, np.int64), np.zeros((0, dims))
            label = count(TaskContext.get().partitionId() << 32)

            def made(i: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
                top = float(np.sqrt((c**2).sum(1)).max())
                most = float(abs(c).max(initial=0))
                held = next((t for t, m in (("<i2", 2**15), ("<i4", 2**31)) if most < m), "<f8")
                return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([next(label)], pa.int64()), pa.array([top]), pa.array([len(i)], pa.int32()), pa.array([i.tobytes()], pa.binary()), pa.array([c.astype(held).tobytes()], pa.binary()), pa.array([held])], names=["kind", "block", "top", "n", "ids", "cells", "held"])

            for batch in batches:
                ids = np.concatenate([ids, batch.column(0).to_numpy()])
                cells = np.concatenate([cells, padded(batch.column(1))])
                while len(ids) >= size:
                    yield made(ids[:size], cells[:size])
                    ids, cells = ids[size:], cells[size:]
            if len(ids):
                yield made(ids, cells)

        dealt = rows.repartitionByRange(n, F.col("norm").desc(), "id").sortWithinPartitions(F.col("norm").desc(), "id")
        return staged(dealt.select("id", "v").mapInArrow(cut, BLOCKS), "blocks")

    candidates = blocks_of(good, 1, block)
    asked = blocks_of(good.where("q"), 0, query_block)
    # a number per block, by a window without the cells, which then come by a join
    keyed = asked.select(F.col("block").alias("h")).withColumn("b", F.row_number().over(Window.orderBy("h")) - 1)
    asked = staged(asked.join(keyed, asked["block"] == F.col("h")).select("kind", F.col("b").cast("int").alias("block"), "top", "n", "ids", "cells", "held"), "queries")
    many = asked.count()
    groups = max(1, min(n, candidates.count()))
    longest = candidates.orderBy(F.desc("top")).limit(1)

    def arrays(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray]:
        names = batch.schema.names
        ids = np.frombuffer(batch.column(names.index("ids"))[r].as_py(), np.int64)
        held = batch.column(names.index("held"))[r].as_py()
        return ids, np.frombuffer(batch.column(names.index("cells"))[r].as_py(), held).astype(np.float64).reshape(len(ids), dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, cell = None, None
        for batch in batches:
            kinds, blocks, cells = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("kind", "block", "cell"))
            tops, floors = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("top", "floor"))
            for r, kind in enumerate(kinds):
                if kind == 0:
                    if best:
                        yield _record(list(best.hits(cell[0])))
                    cell = (blocks[r], cells[r])
                    floor = np.frombuffer(floors[r], np.float64).copy() if floors[r] else None
                    best = _Best(*arrays(batch, r), k, turn, ahead, floor)
                else:
                    best.add(*arrays(batch, r), tops[r])
        if best:
            yield _record(list(best.hits(cell[0])))

    def grid(asked: DataFrame, candidates: DataFrame, groups: int, needs: np.ndarray) -> DataFrame:
        """Each cell's query block, then its candidate blocks by descending length.  Query blocks are numbered by the
        length that they need, so a candidate block goes to the first ones, as many as its length reaches."""

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tops = batch.column(1).to_numpy() * (1 + 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.searchsorted(needs, tops, side="right"), pa.int64())], names=["of", "many"])

        qs = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cell"))
        near = candidates.select("block", "top").mapInArrow(reached, "of long, many long").where("many > 0")
        cs = candidates.join(near, candidates["block"] == near["of"]).withColumn("cell", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
        cs = cs.select("kind", F.explode(F.sequence(F.lit(0), (F.col("many") - 1).cast("int"))).alias("block"), "top", "n", "ids", "cells", "held", "cell", F.lit(None).cast("binary").alias("floor"))
        both = qs.unionByName(cs).repartition(max(n, groups), "block", "cell").sortWithinPartitions("block", "cell", "kind", F.desc("top"))
        return both.mapInArrow(run, HITS)

    # thresholds from the longest vectors: k rows a query
    first = grid(asked.withColumn("floor", F.lit(None).cast("binary")), longest, 1, np.full(many, -np.inf))
    scored = first.groupBy("qblock", "pos").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("c")).where(F.col("c") >= k)
    floors = scored.groupBy("qblock").agg(F.collect_list(F.struct("pos", "s")).alias("at"))  # a query block's rows

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "n", "at", "ids", "cells", "held"]
        for batch in batches:
            out, need = [], []
            for r, (size, at) in enumerate(zip(*(batch.column(names.index(c)).to_pylist() for c in ("n", "at")))):
                f = np.full(size, -np.inf)
                for x in at or ():
                    f[x["pos"]] = x["s"]
                out.append(f.tobytes())
                norms = np.sqrt((arrays(batch, r)[1] ** 2).sum(1))
                # the length that a vector must have to reach the threshold of any query here
                need.append(float(np.where(f > 0, f / np.maximum(norms, 1e-300), -np.inf).min()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(need, pa.float64())], names=["block", "floor", "need"])

    begun = asked.join(floors, asked["block"] == floors["qblock"], "left").select("block", "n", "at", "ids", "cells", "held")
    begun = staged(begun.mapInArrow(start, "block int, floor binary, need double"), "floors")
    # a number per query block
    begun = staged(begun.withColumn("turn", (F.row_number().over(Window.orderBy("need", "block")) - 1).cast("int")), "turns")
    needs = np.array([r.need for r in begun.select("need").orderBy("need").collect()])
    asked = asked.join(begun.select("block", "floor", "turn"), "block").select(*("turn" if c == "block" else c for c in asked.columns), "floor").withColumnRenamed("turn", "block")
    hits = grid(asked, candidates, groups, needs)
    rank = F.row_number().over(Window.partitionBy("qblock", "pos").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
