"""All sweeps of a graph, or of parts of one that do not touch, whose adjacency is no more than one task's share.

Such a graph lies in one bucket, so that every sweep is one task anyway; that task then makes them all, on arrays sorted by the pulling vertex, instead of a job for
each few. So does a task for the components that a large graph falls into where known vertices, which never change, are taken out. A whole graph is bounded by ``propagate.ROWS_PER_TASK`` rows, edges and vertices
together twice that; a component by ``propagate.SETTLE_ROWS``. Rules and results are those of the distributed sweeps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from tidegraph.functions.numeric import LABEL, Numeric
from tidegraph.storage import Table

#: A sweep pulls the rows of the movers' neighbours alone if theirs are at most a FEW-th of all rows.
FEW = 16


@dataclass
class Local:
    """Arrays of a graph: rows of edges sorted by the pulling vertex, every vertex among them by its loop."""

    nbr: np.ndarray
    w: np.ndarray
    starts: np.ndarray
    open: np.ndarray
    fixed: bool

    def __post_init__(self):
        # Sums of a vertex must fit 64 bits.
        if self.fixed and len(self.w) and np.add.reduceat(self.w.astype(float), self.starts).max() * LABEL >= 1 << 62:
            self.w = self.w.astype(object)
        self.sizes = np.diff(self.starts, append=len(self.w))
        self.whole = np.add.reduceat(self.w, self.starts)
        self.pulls = (self.whole > (0 if self.fixed else 1e-10)).astype(bool)
        self.divide = np.where(self.pulls, self.whole, 1)

    def rows_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the vertices ``at``, and where those of each begin among them."""
        n = self.sizes[at]
        begins = np.cumsum(n) - n
        return np.repeat(self.starts[at] - begins, n) + np.arange(n.sum()), begins

    def mean(self, part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        if not self.fixed:
            return np.clip(part / whole, 0.0, 1.0)
        q, r = part // whole, part % whole
        return np.clip((q + (2 * r >= whole)).astype(np.int64), 0, LABEL)

    def sweep(self, f: np.ndarray, moved: np.ndarray, everyone: bool, alone: bool) -> np.ndarray:
        """Labels after one sweep of the open vertices: of all, of the ``moved`` alone, or of those and their neighbours."""
        able = self.open & self.pulls
        if everyone or FEW * self.sizes[moved].sum() > len(self.nbr):
            mean = self.mean(np.add.reduceat(self.w * f[self.nbr], self.starts), self.divide)
            if not everyone:
                able &= moved if alone else np.logical_or.reduceat(moved[self.nbr], self.starts)
            return np.where(able, mean, f)
        # Whoever moves is open and has all its rows here, its loop among them, so its neighbours are those that it moves.
        touched = moved
        if not alone:
            touched = np.zeros(len(f), bool)
            touched[self.nbr[self.rows_of(np.flatnonzero(moved))[0]]] = True
        at = np.flatnonzero(touched & able)
        new = f.copy()
        if len(at):
            rows, begins = self.rows_of(at)
            new[at] = self.mean(np.add.reduceat(self.w[rows] * f[self.nbr[rows]], begins), self.divide[at])
        return new


def iterate(graph: Local, f: np.ndarray, moved: np.ndarray, step, most: int, full: bool, done: int = 0) -> tuple[np.ndarray, int, bool, int]:
    """Labels, iterations, whether nothing moves any more, and sweeps made; see ``propagate``. ``done`` sweeps were made before."""
    seen, held = {}, None
    while moved.any() and done < most:
        new = graph.sweep(f, moved, full, done == 0)
        f, moved, done = new, np.abs(new - f) > step, done + 1
        if held:
            at, period, f0, m0 = held
            if done == at + period:
                if (f == f0).all() and (moved == m0).all():
                    for _ in range((most - done) % period):
                        new = graph.sweep(f, moved, full, False)
                        f, moved, done = new, np.abs(new - f) > step, done + 1
                    return f, most, not moved.any(), done
                held = None
            continue
        digest = hashlib.blake2b(f.tobytes() + moved.tobytes(), digest_size=16).digest()
        before = seen.setdefault(digest, done)
        if before != done:
            seen[digest], held = done, (done, done - before, f, moved)
    return f, done, not moved.any(), done


def arranged(ids: np.ndarray, src: np.ndarray, nbr: np.ndarray, w: np.ndarray, open_: np.ndarray, fixed: bool) -> Local:
    """The graph of sorted ``ids`` from rows of edges, a loop of no weight added for each vertex."""
    src, nbr, w = (np.concatenate(x) for x in ((src, ids), (nbr, ids), (w, np.zeros(len(ids), w.dtype))))
    at, to = np.searchsorted(ids, src), np.searchsorted(ids, nbr)
    by = np.lexsort((to, at))
    return Local(to[by], w[by], np.searchsorted(at[by], np.arange(len(ids))), open_, fixed)


def settle_parts(rows: DataFrame, step, numeric: Numeric, most: int, done: int) -> tuple[Table, int, bool]:
    """A table (id, f) of the pulling vertices of ``rows`` (part, id, nbr, w, and f, open and moved of nbr), iterations and converged.

    A part holds whole components with their loops and the known vertices beside them, and is swept in a task of its own.
    """
    kind, fixed = rows.schema["f"].dataType, numeric.fixed

    def run(table: pa.Table) -> pa.Table:
        src, nbr, w, f, open_, moved = (table.column(c).to_numpy() for c in ("id", "nbr", "w", "f", "open", "moved"))
        ids, first = np.unique(nbr, return_index=True)
        mine = np.isin(ids, src)
        graph = arranged(ids, src, nbr, w, open_[first].astype(bool), fixed)
        f, iterations, settled, _ = iterate(graph, f[first], moved[first].astype(bool), step, most, False, done)
        n = int(mine.sum())
        return pa.table({"id": ids[mine], "f": f[mine], "iterations": np.full(n, iterations), "settled": np.full(n, settled)})

    made = rows.groupBy("part").applyInArrow(run, f"id long, f {kind.simpleString()}, iterations long, settled boolean")
    seen = Observation()
    out = Table(made.observe(seen, F.max("iterations").alias("iterations"), F.min("settled").alias("settled")).select("id", "f"))
    return out, seen.get["iterations"], seen.get["settled"]


def settle(adj: DataFrame, state: DataFrame, step, numeric: Numeric, most: int, full: bool) -> tuple[Table, int, bool, int]:
    """A table (id, f), iterations, converged and sweeps made, from the edges with loops (id, nbr, w) and the state (id, open, f, moved)."""
    kind, fixed = state.schema["f"].dataType, numeric.fixed
    edges = adj.select("id", "nbr", "w", F.lit(None).cast(kind).alias("f"), F.lit(None).cast("boolean").alias("open"), F.lit(None).cast("boolean").alias("moved"))
    rows = state.select("id", F.lit(None).cast("long").alias("nbr"), F.lit(None).cast(adj.schema["w"].dataType).alias("w"), "f", "open", "moved")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        edge = np.asarray(table.column("nbr").is_valid())
        of = lambda mask, *columns: (table.filter(pa.array(mask)).column(c).to_numpy() for c in columns)
        ids, f, open_, moved = of(~edge, "id", "f", "open", "moved")
        order = np.argsort(ids)
        ids, f, open_, moved = ids[order], f[order], open_[order].astype(bool), moved[order].astype(bool)
        src, nbr, w = of(edge, "id", "nbr", "w")
        both = np.isin(src, ids) & np.isin(nbr, ids)
        graph = arranged(ids, src[both], nbr[both], w[both], open_, fixed)
        f, iterations, settled, swept = iterate(graph, f, moved, step, most, full)
        same = lambda x: pa.array(np.full(len(ids), x))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(f), same(iterations), same(settled), same(swept)], names=["id", "f", "iterations", "settled", "swept"])

    made = edges.unionByName(rows).coalesce(1).mapInArrow(run, f"id long, f {kind.simpleString()}, iterations long, settled boolean, swept long")
    seen = Observation()
    out = Table(made.observe(seen, *[F.max(c).alias(c) for c in ("iterations", "settled", "swept")]).select("id", "f"))
    got = seen.get
    return out, got["iterations"], got["settled"], got["swept"]
