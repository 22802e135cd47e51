"""Tables of a changing graph and their invariants."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

VERTICES = "id long, true_label int, batch_id int, delete_batch int, gt_class int"
EDGES = "src long, dst long, w double"


@dataclass(frozen=True)
class Graph:
    """vertices (VERTICES) and undirected edges (src < dst, one row each; w double, or long in fixed point).

    A vertex without a batch_id never arrives; gt_class counts from its arrival on. Edges may have a column ``since`` (int): an edge that comes
    in a later batch than both its ends is active from that batch on; null: it was always known. lines: the edges with what their ends say about
    them, see ``state.timeline``, where whoever makes the edges knows it; else it is joined to them. cells: the edges as they were made
    (``operators.cells.Cells``), where they were made by pairs of blocks; its lines are those.
    """

    vertices: DataFrame
    edges: DataFrame
    lines: DataFrame | None = None
    cells: Any = None


def violations(graph: Graph) -> DataFrame:
    """(rule, n): how many rows break each invariant; all zero for a sound graph. One job; a row of null is no order, no weight and no vertex."""
    v, e = graph.vertices, graph.edges
    bad = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    pairs = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("w").isNull() | (F.col("w") <= 0)).alias("light"))
    of_edges = pairs.agg(
        bad(F.when(F.coalesce(F.col("src") >= F.col("dst"), F.lit(True)), F.col("n"))).alias("self_loop_or_order"),
        F.count_if(F.col("n") > 1).alias("repeated_edge"),
        bad("light").alias("weight_not_positive"),
    )
    each = v.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("gt_class").isNotNull() & F.col("delete_batch").isNotNull()).alias("known"),
        F.count_if(F.col("delete_batch") < F.col("batch_id")).alias("early"),
    )
    of_vertices = each.agg(F.count_if(F.col("n") > 1).alias("repeated_vertex"), bad("known").alias("known_vertex_deleted"), bad("early").alias("deleted_before_arrival"))
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    of_ends = ends.join(v.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_endpoint"))
    out = None
    for some in (of_edges, of_vertices, of_ends):
        one = some.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in some.columns])).alias("x")).select("x.*")
        out = one if out is None else out.unionByName(one)
    return out


def check(graph: Graph) -> Graph:
    """``graph``, if it breaks no invariant; else a ValueError that names the rules and how many rows break each."""
    broken = {r.rule: r.n for r in violations(graph).where("n > 0").collect()}
    if broken:
        raise ValueError(f"not a sound graph: {broken}")
    return graph
