"""Edges of a graph of all pairs, as they were made: by cells, a pair of blocks of vertices each, and never shuffled.

A cell's edges lie once, not in both directions, in a few rows (tiles) of ids, numbers in the block and weights, some six bytes an edge; the table is in
buckets by cell. For a sweep each vertex's label goes to the cells of its block (as many as there are blocks), is multiplied by the tiles there, and comes back
as a sum a cell. So what is shuffled follows the vertices and blocks, and what is kept are the tiles; nothing is persisted. An edge lives
while both its ends do, so who is among the labels says which edges count. Fixed point only: sums of a cell are 64-bit integers (a block has
under 2^16 vertices, a weight at most 2^20, a label 2^27), those of a vertex decimals.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A row of edges: ids of a strip of one block and of the whole other one, edges of each id of the strip, and of each edge the number in the other block and the weight.
TILE = "cell int, rows binary, cols binary, counts binary, at binary, w binary"
#: A product of a weight and the low or high part of a label stays exact in a sum of doubles.
LOW = 14


def block_of(id_: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int")


def cells_of(own: str, blocks: int) -> Column:
    """The cells of block ``own``, one with each block."""
    return F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: (F.least(own, o) * blocks + F.greatest(own, o)).cast("int"))


def tile(cell: int, rows: np.ndarray, cols: np.ndarray, src: np.ndarray, at: np.ndarray, w: np.ndarray) -> dict[str, object]:
    """A row of ``TILE`` of edges sorted by their numbers ``src`` among ``rows``."""
    counts = np.bincount(src, minlength=len(rows)).astype(np.int32)
    return {"cell": cell, "rows": rows.tobytes(), "cols": cols.tobytes(), "counts": counts.tobytes(), "at": at.astype(np.uint16 if len(cols) <= 1 << 16 else np.int32).tobytes(), "w": w.astype(np.int32).tobytes()}


def edges_in(tiles: pa.Table | pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """rows, cols, src, at and w of a tile."""
    raw = lambda c, kind: np.frombuffer(tiles.column(c)[i].as_py(), kind)
    rows, cols, counts, w = (raw(c, kind) for c, kind in (("rows", np.int64), ("cols", np.int64), ("counts", np.int32), ("w", np.int32)))
    return rows, cols, np.repeat(np.arange(len(rows)), counts), raw("at", np.uint16 if len(cols) <= 1 << 16 else np.int32), w.astype(np.int64)


class Places:
    """Where ids lie among those of a table."""

    def __init__(self, ids: np.ndarray):
        self.order = np.argsort(ids)
        self.ids = ids[self.order]

    def of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``some``, and whether they are there."""
        if not len(self.ids):
            return np.zeros(len(some), np.int64), np.zeros(len(some), bool)
        at = np.minimum(np.searchsorted(self.ids, some), len(self.ids) - 1)
        return self.order[at], self.ids[at] == some


def _summed(n: int, to: np.ndarray, w: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Exact sums of w f by ``to``."""
    low, high = f & ((1 << LOW) - 1), f >> LOW
    return np.bincount(to, w * low, n).astype(np.int64) + (np.bincount(to, w * high, n).astype(np.int64) << LOW)


def _sums(tiles: pa.Table, labels: pa.Table) -> tuple[np.ndarray, ...]:
    """part, whole, near and nudged of each row of ``labels`` (id, f, moved; rows without a label pull, but are not pulled)."""
    n, f = labels.num_rows, labels.column("f")
    counts = np.asarray(f.is_valid())
    f, moved = f.fill_null(0).to_numpy(), labels.column("moved").fill_null(False).to_numpy().astype(bool) & counts
    places = Places(labels.column("id").to_numpy())
    part, whole, near, nudged = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(tiles.num_rows):
        rows, cols, src, at, w = edges_in(tiles, i)
        ends = [(*places.of(rows), src), (*places.of(cols), at)]
        for (to, there, mine), (other, known, its) in (ends, ends[::-1]):
            if not (there.any() and known.any()):
                continue
            source = known & counts[other]
            live = source[its]
            mine, its, weight = (mine, its, w) if live.all() else (mine[live], its[live], w[live])
            m = len(to)
            here = [_summed(m, mine, weight, f[other][its]), np.bincount(mine, weight, m).astype(np.int64), np.bincount(mine, minlength=m)]
            for total, one in zip((part, whole, near), here):
                total[to[there]] += one[there]
            if (shaken := moved[other] & source).any():
                nudged[to[there]] |= (np.bincount(mine, shaken[its], m) > 0)[there]
    return part, whole, near, nudged


@dataclass
class Cells:
    """tiles: ``TILE`` in ``buckets`` buckets by cell, of so many ``blocks``; lines: the same edges as rows (src, dst, w, free)."""

    tiles: DataFrame
    blocks: int
    buckets: int
    lines: DataFrame

    def where(self, kept: Column) -> Cells:
        return replace(self, lines=self.lines.where(kept))

    def _sent(self, rows: DataFrame, *columns: Column, own: list[Column] | None = None) -> DataFrame:
        """``rows`` (id and ``columns``) in each cell of their blocks, with ``own`` in the one of a block with itself and nulls elsewhere."""
        placed = rows.withColumn("__block", block_of("id", self.blocks)).withColumn("__cell", F.explode(cells_of("__block", self.blocks)))
        more = [F.when(F.col("__cell") == F.col("__block") * (self.blocks + 1), c).alias(f"own{i}") for i, c in enumerate(own or ())]
        return placed.select(F.col("__cell").alias("cell"), "id", *columns, *more).repartition(self.buckets, "cell")

    def sums(self, rows: DataFrame, f: Column, moved: Column, keep: list[str]) -> DataFrame:
        """The columns ``keep`` of ``rows`` (id and more) with part, whole, near and nudged: sums of w f and of w over the neighbours with a label ``f`` among the rows, how many there are, and whether one of them ``moved``."""
        kinds = ["boolean", *(rows.schema[c].dataType.simpleString() for c in keep)]
        schema = ", ".join(["id long", "part long", "whole long", "near long", "nudged boolean", *(f"own{i} {k}" for i, k in enumerate(kinds))])

        def run(tiles: pa.Table, labels: pa.Table) -> pa.Table:
            if not labels.num_rows:
                return pa.table({})
            part, whole, near, nudged = _sums(tiles, labels)
            own = {f"own{i}": labels.column(f"own{i}") for i in range(len(kinds))}
            out = pa.table({"id": labels.column("id"), "part": part, "whole": whole, "near": near, "nudged": nudged, **own})
            return out.filter(pa.array((near > 0) | np.asarray(labels.column("own0").is_valid())))

        sent = self._sent(rows, f.cast("long").alias("f"), moved.alias("moved"), own=[F.lit(True), *map(F.col, keep)])
        made = self.tiles.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(run, schema)
        mine = [F.max(f"own{i}").alias(c) for i, c in enumerate(keep, 1)]
        return made.groupBy("id").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"), F.sum("whole").alias("whole"), F.sum("near").alias("near"), F.max("nudged").alias("nudged"), *mine)

    def beside(self, rows: DataFrame) -> DataFrame:
        """(id, nbr, w, root) of the edges of the vertices of ``rows`` (id, root), loops of no weight among them."""

        def run(tiles: pa.Table, rows: pa.Table) -> pa.Table:
            if not (rows.num_rows and tiles.num_rows):
                return pa.table({})
            places, roots, out = Places(rows.column("id").to_numpy()), rows.column("root").to_numpy(), []
            for i in range(tiles.num_rows):
                a, b, src, at, w = edges_in(tiles, i)
                for (x, mine), (y, its) in (((a, src), (b, at)), ((b, at), (a, src))):
                    to, there = places.of(x)
                    wanted = there[mine]
                    out.append((x[mine[wanted]], y[its[wanted]], w[wanted], roots[to[mine[wanted]]]))
            return pa.table(dict(zip(("id", "nbr", "w", "root"), map(np.concatenate, zip(*out)))))

        made = self.tiles.groupBy("cell").cogroup(self._sent(rows, F.col("root")).groupBy("cell")).applyInArrow(run, "id long, nbr long, w long, root long")
        return made.unionByName(rows.select("id", F.col("id").alias("nbr"), F.lit(0).cast("long").alias("w"), "root"))
