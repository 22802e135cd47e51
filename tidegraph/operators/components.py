"""Connected components by rounds of hooking, pointer doubling and contraction.

A round lets every vertex point at its smallest neighbour (or itself), doubles the pointers
until all reach a local minimum, and contracts the graph to those minima. Every minimum that
still has an edge absorbs a neighbour, so the vertex count at least halves per round.
Joins on a hub's id are plain shuffled joins, which adaptive execution splits when skewed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F, types as T

from tidegraph.storage import Table, settled


#: Edges whose vertices may be broadcast.
FEW = 1 << 12


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def hook(edges: DataFrame) -> DataFrame:
    """(id, root): each endpoint with the smallest id among itself and its neighbours."""
    both = _symmetric(edges)
    return both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("root"))


def jump(parents: DataFrame) -> DataFrame:
    """(id, root, moved): each vertex with its parent's parent."""
    grand = parents.select(F.col("id").alias("root"), F.col("root").alias("up"))
    return parents.join(grand, "root").select("id", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved"))


def _jump_to_roots(parents: DataFrame, dealt: Callable[[DataFrame], DataFrame]) -> Table:
    """(id, root): pointers doubled twice a job until all reach a root."""
    before = None
    while True:
        seen = Observation()
        twice = jump(dealt(jump(dealt(parents)).select("id", "root")))
        after = Table(twice.observe(seen, F.coalesce(F.sum(F.col("moved").cast("int")), F.lit(0)).alias("moved")))
        if before:
            before.drop()
        if not seen.get["moved"]:
            return after
        before, parents = after, after.df.select("id", "root")


@settled
def connected_components(edges: DataFrame, vertices: DataFrame | None = None, few: int | None = None) -> DataFrame:
    """(id, root): every vertex with the smallest id of its component.

    ``edges`` has columns ``src`` and ``dst`` of one orderable type; direction, repeats,
    self-loops and edges with a null end do not matter. ``vertices`` (column ``id``) adds
    vertices without edges; without it only endpoints are returned. No edges: each vertex
    is its own component. Tables of the vertices of over ``few`` edges (FEW) are not broadcast. The work is done by the call; the
    result is a table in the shared folder.
    """
    kind = edges.schema["src"].dataType
    # Whatever made the edges runs once: everything below reads them from here, at most a row for each vertex of a task.
    seen, ends = Observation(), edges.select("src", "dst")
    if kind == T.LongType():
        ends = ends.mapInArrow(_forest, "src long, dst long")
    given = Table(ends.distinct().observe(seen, F.count_if(F.col("src") != F.col("dst")).alias("open")))
    known = given.df.select(F.explode(F.array("src", "dst")).alias("id"))
    rest, labels, contracted = given.df.where("src != dst"), None, None
    # Pointers of many vertices meet by shuffles, as a broadcast passes the driver.
    dealt = (lambda df: df.hint("merge")) if seen.get["open"] > (FEW if few is None else few) else lambda df: df
    while seen.get["open"]:
        roots = _jump_to_roots(hook(rest), dealt)
        step = dealt(roots.df.select("id", "root"))
        src = step.select(F.col("id").alias("src"), F.col("root").alias("a"))
        dst = step.select(F.col("id").alias("dst"), F.col("root").alias("b"))
        seen, before = Observation(), contracted
        contracted = Table(
            rest.join(src, "src").join(dst, "dst").where("a != b")
            .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct().observe(seen, F.count(F.lit(1)).alias("open"))
        )
        rest = contracted.df
        if before:
            before.drop()
        if labels is None:
            labels = roots
            continue
        up = step.select(F.col("id").alias("root"), F.col("root").alias("up"))
        after = Table(labels.df.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root")))
        labels.drop()
        roots.drop()
        labels = after
    spark = edges.sparkSession
    found = labels.df.select("id", "root") if labels else spark.createDataFrame([], T.StructType([T.StructField("id", kind), T.StructField("root", kind)]))
    everyone = (vertices.select("id").unionByName(known) if vertices is not None else known).where("id is not null").distinct()
    return everyone.join(dealt(found), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


@settled
def maintained_components(before: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, root) of ``vertices`` (id) under ``edges`` (src, dst), from that of the batch ``before``; as ``connected_components`` has it.

    added, removed: the edges that came and went since; vertices that came and went follow from ``vertices``. Components that lost an edge or a vertex
    are searched again, over their own vertices only. Added edges then join components: a graph of roots, as large as the edges that join two. Untouched
    components are passed on.
    """
    gone = before.join(vertices, "id", "left_anti").select("id")
    lost = removed.select(F.explode(F.array("src", "dst")).alias("id")).union(gone).distinct()
    torn = Table(before.join(lost, "id", "left_semi").select("root").distinct()).df
    inside = Table(before.join(torn, "root", "left_semi").select("id").join(vertices, "id", "left_semi")).df
    end = lambda c: inside.withColumnRenamed("id", c)
    found = connected_components(edges.select("src", "dst").join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi"), inside)
    new = vertices.select("id").join(before, "id", "left_anti").select("id", F.col("id").alias("root"))
    apart = Table(before.join(torn, "root", "left_anti").select("id", "root").unionByName(found).unionByName(new)).df
    of = lambda c, r: apart.select(F.col("id").alias(c), F.col("root").alias(r))
    bridges = added.select("src", "dst").join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a != b")
    joined = connected_components(bridges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    up = joined.select(F.col("id").alias("root"), F.col("root").alias("up"))
    return apart.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"))


#: Vertices that a task joins at once.
AT_ONCE = 1 << 20


def _joined(batches: Iterator[pa.RecordBatch], names: tuple[str, str] = ("id", "root"), most: int | None = None) -> Iterator[pa.RecordBatch]:
    """(id, root) of the ends of all edges of a task, by union-find; begun anew whenever over ``most`` vertices are joined."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(x) for x in up], pa.int64())], names=list(names))

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            # An edge without one of its ends says no more than that the other is there.
            a, b = b if a is None else a, a if b is None else b
            if a is None:
                continue
            up.setdefault(a, a)
            up.setdefault(b, b)
            low, high = sorted((find(a), find(b)))
            up[high] = low
        if most and len(up) > most:
            yield rows()
            up.clear()
    yield rows()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst): edges that connect what the edges (src, dst) of a task connect, a row for each of its vertices."""
    yield from _joined(batches, ("src", "dst"), AT_ONCE)


def components_of_few(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``connected_components`` of ``edges`` (src, dst long, no nulls) that are no more than one task's share, by that task; part of the plan that asks for it."""
    found = edges.select("src", "dst").coalesce(1).mapInArrow(_joined, "id long, root long")
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def component_ids(components: DataFrame) -> DataFrame:
    """(id, root, component_id): dense numbers from 0 in the order of the roots.

    Only the distinct roots are ranked, range-partitioned rather than in one task.
    """
    from tidegraph.sources.generate import ranked

    roots = ranked(components.select("root").distinct(), ["root"], "component_id")
    return components.join(roots, "root").select("id", "root", F.col("component_id").cast("long").alias("component_id"))


def singleton_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) of the vertices without an edge: each its own component."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return vertices.select("id").join(ends, "id", "left_anti").select("id", F.col("id").alias("root"))
