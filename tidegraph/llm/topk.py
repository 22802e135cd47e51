"""Exact top-k search by columnar branch and bound.

Vectors lie in vertical layout (one row a dimension). Scores grow by blocks of dimensions; after
each block a candidate goes for good if its partial score plus the largest product its
remaining mass allows (Cauchy-Schwarz on the norms still to come) is under the query's k-th score so far.
Once few pairs survive they are kept as a compact list.

Scale: queries are hashed into blocks of about ``queries_at_once``, candidates into blocks of at most ``rows_at_once``, and
every pair of blocks is a cell of its own: a shuffle brings a copy of each block to each of its cells, where the queries
come first and the candidates stream past them. Nothing goes through the driver or is broadcast, a task holds one block of
queries at a time, and a cell returns k rows for each query, of which the best are kept.

Defined cases. Vectors that are null or hold null or non-finite components, and rows without
an id, take no part. Shorter vectors count as padded with zeros; an empty one scores 0 with
all. Repeated rows are different candidates: a row is never its own, but a copy of it may be.
Ties go to the smaller id. An empty table, or one without queries, gives no rows. Components
are taken as floor(256 x) in 64-bit integers; scores must fit those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidegraph.llm.common import with_row_id
from tidegraph.storage import materialize, settled

SCHEMA = "query_row long, query_id long, row long, vec_id long, score long"
EXACT = float(1 << 53)


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, v array<long>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    rows = with_row_id(table.select("vec_id", "embedding"), "row")
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("row", "vec_id", whole.alias("v"))


def to_matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """(dims, rows) in 64-bit integers, padded with zeros."""
    ends = np.asarray(lists.offsets, dtype=np.int64)
    lengths = np.diff(ends)
    values = np.asarray(lists.values.slice(ends[0], ends[-1] - ends[0]) if len(ends) else [], dtype=np.int64)
    if len(lengths) and (lengths == dims).all():
        return np.ascontiguousarray(values.reshape(-1, dims).T)
    out = np.zeros((dims, len(lengths)), np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths)
    inner = np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], lengths)
    fits = inner < dims
    out[inner[fits], at[fits]] = values[fits]
    return out


class Best:
    """The k best candidates of each query so far, ties to the smaller id, then the earlier row."""

    def __init__(self, queries: int, k: int):
        self.k, self.n = k, queries
        self.q, self.score, self.ids, self.rows = (np.zeros(0, np.int64) for _ in range(4))
        self.floor = np.full(queries, -np.inf)

    def add(self, q, score, ids, rows) -> None:
        q, score, ids, rows = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((rows, ids, -score, q))
        q = q[order]
        first = np.searchsorted(q, np.arange(self.n))
        rank = np.arange(len(q)) - first[q]
        keep = order[rank < self.k]
        self.q, self.score, self.ids, self.rows = q[rank < self.k], score[order][rank < self.k], ids[keep], rows[keep]
        full = rank == self.k - 1
        self.floor[q[full]] = score[order][full]


def search_chunk(queries: np.ndarray, query_rows: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: Best, block: int) -> None:
    """Add candidates ``x`` (dims, n) to ``best`` for ``queries`` (dims, m)."""
    dims, exact = len(x), np.float64
    if dims and float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) * dims >= EXACT:
        exact = np.int64
    qf, xf = queries.astype(exact), x.astype(exact)
    q_mass = np.sqrt(np.cumsum(qf.astype(float)[::-1] ** 2, axis=0)[::-1])
    x_mass = np.sqrt(np.cumsum(xf.astype(float)[::-1] ** 2, axis=0)[::-1])
    part = np.zeros((queries.shape[1], x.shape[1]), exact)
    cols = np.arange(x.shape[1])
    at, pairs = 0, None
    while at < dims:
        to = min(dims, at + block)
        if pairs is None:
            part += qf[at:to].T @ xf[at:to][:, cols]
        else:
            part += np.einsum("ij,ij->j", qf[at:to][:, pairs[0]], xf[at:to][:, pairs[1]])
        at = to
        if at == dims:
            break
        slack = 1 + 1e-9
        if pairs is None:
            alive = part + q_mass[at][:, None] * x_mass[at][cols][None, :] * slack >= best.floor[:, None]
            if alive.mean() < 0.2:
                pairs = np.nonzero(alive)
                part, pairs = part[pairs], (pairs[0], cols[pairs[1]])
            elif not (some := alive.any(axis=0)).all():
                cols, part = cols[some], part[:, some]
        else:
            alive = part + q_mass[at][pairs[0]] * x_mass[at][pairs[1]] * slack >= best.floor[pairs[0]]
            part, pairs = part[alive], (pairs[0][alive], pairs[1][alive])
    if pairs is None:
        pairs = np.nonzero(part >= best.floor[:, None])
        part, pairs = part[pairs], (pairs[0], cols[pairs[1]])
    own = (rows[pairs[1]] != query_rows[pairs[0]]) & (part >= best.floor[pairs[0]])
    q, c = pairs[0][own], pairs[1][own]
    best.add(q, part[own].astype(np.int64), ids[c], rows[c])


@settled
def top_k(table: DataFrame, is_query: Column, k: int = 5, dim_block: int = 16, queries_at_once: int = 1 << 14, rows_at_once: int = 1 << 16, least_rows: int = 1024, chunk: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of ``table`` by integer inner product for each query row."""
    vectors = materialize(integer_vectors(table).withColumn("asked", F.coalesce(is_query, F.lit(False))))
    rows, asked = vectors.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    # Smaller tables are cut finer, so that every core has a cell.
    size = max(least_rows, min(rows_at_once, rows // (4 * table.sparkSession.sparkContext.defaultParallelism)))
    across, down = -(-asked // queries_at_once), max(1, -(-rows // size))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if not asked:
        return table.sparkSession.createDataFrame([], SCHEMA).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    ours = vectors.where("asked").select(block(across).alias("i"), every(down).alias("j"), F.lit(0).alias("side"), "row", "vec_id", "v")
    theirs = vectors.select(every(across).alias("i"), block(down).alias("j"), F.lit(1).alias("side"), "row", "vec_id", "v")
    cells = ours.unionByName(theirs).repartition("i", "j").sortWithinPartitions("i", "j", "side")
    found = cells.mapInArrow(_searcher(k, dim_block, chunk), SCHEMA)
    better = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(better)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Cell:
    """A block of queries and the best candidates that it has met."""

    def __init__(self, k: int):
        self.k, self.held, self.best = k, [], None

    def ask(self, part: pa.RecordBatch) -> None:
        self.held.append(part)

    def meet(self, part: pa.RecordBatch, dim_block: int, chunk: int) -> None:
        if not self.held:
            return
        if self.best is None:
            queries = pa.Table.from_batches(self.held).combine_chunks()
            lists = queries.column("v").combine_chunks()
            self.queries = to_matrix(lists, max([1, *lists.value_lengths().to_pylist()]))
            self.rows, self.ids = np.asarray(queries.column("row")), np.asarray(queries.column("vec_id"))
            self.best = Best(len(self.rows), self.k)
        x, ids, rows = to_matrix(part.column("v"), len(self.queries)), np.asarray(part.column("vec_id")), np.asarray(part.column("row"))
        at, step = 0, 64
        while at < len(ids):
            search_chunk(self.queries, self.rows, x[:, at : at + step], ids[at : at + step], rows[at : at + step], self.best, dim_block)
            at, step = at + step, min(chunk, step * 4)

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.best is not None:
            b = self.best
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (self.rows[b.q], self.ids[b.q], b.rows, b.ids, b.score)], names=["query_row", "query_id", "row", "vec_id", "score"])


def _searcher(k: int, dim_block: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at = Cell(k), None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in ("i", "j", "side")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if at != (keys[0, a], keys[1, a]):
                    yield from cell.found()
                    cell, at = Cell(k), (keys[0, a], keys[1, a])
                part = batch.slice(a, b - a)
                cell.meet(part, dim_block, chunk) if keys[2, a] else cell.ask(part)
        yield from cell.found()

    return run


def op6_top_k(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
