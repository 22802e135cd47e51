"""The subgraph of strong edges between newly arrived vertices, and who new edges affect."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegraph.operators.state import adjacency, endpoints, live, new_edges, open_vertices


def new_vertices(vertices: DataFrame, batch: int) -> DataFrame:
    """(id): arrivals of ``batch`` that also outlive it, known ones included."""
    return vertices.where((F.col("batch_id") == batch) & live(batch)).select("id")


def strong_new_edges(lines: DataFrame, vertices: DataFrame, batch: int, tau) -> DataFrame:
    """(src, dst, w): new edges between new vertices with a weight over tau."""
    if "born" in lines.columns:
        # An edge of a vertex that is gone is not active.
        return new_edges(lines.where(F.col("born") == batch), batch).where(F.col("w") > F.lit(tau))
    fresh = new_vertices(vertices, batch)
    strong = new_edges(lines, batch).where(F.col("w") > F.lit(tau))
    return strong.join(fresh.withColumnRenamed("id", "src"), "src", "left_semi").join(fresh.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "w")


def subgraph_edge_count(lines: DataFrame, vertices: DataFrame, batch: int, tau) -> DataFrame:
    """(directed_edges): two a qualifying edge."""
    return strong_new_edges(lines, vertices, batch, tau).agg((2 * F.count(F.lit(1))).alias("directed_edges"))


def sparsified_subgraph(lines: DataFrame, vertices: DataFrame, batch: int, tau) -> DataFrame:
    """(id, nbr, w) of the strong new edges, both directions."""
    return adjacency(strong_new_edges(lines, vertices, batch, tau))


def insertion_affected(lines: DataFrame, vertices: DataFrame, batch: int, tau, seed_mode: str = "strong") -> DataFrame:
    """(id): live vertices without a known class at an end of a new edge over tau; with ``all``, of any new edge, and every new vertex."""
    edges = new_edges(lines, batch)
    if seed_mode == "strong":
        touched = endpoints(edges.where(F.col("w") > F.lit(tau)))
    elif seed_mode == "all":
        touched = endpoints(edges).union(new_vertices(vertices, batch)).distinct()
    else:
        raise ValueError("seed_mode is 'strong' or 'all'")
    return touched.join(open_vertices(vertices, batch), "id", "left_semi")
