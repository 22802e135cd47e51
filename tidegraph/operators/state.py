"""Graph state at a batch.

Both endpoints' life spans are joined to each edge once (``timeline``); the edges of any batch are
then filters on it, not joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidegraph.schemas import Graph


def live(batch: int) -> Column:
    """Of vertices: arrived by ``batch`` and not deleted by it."""
    return (F.col("batch_id") <= batch) & (F.col("delete_batch").isNull() | (F.col("delete_batch") > batch))


def vertex_status(changes: DataFrame, batch: int) -> DataFrame:
    """(id, status, gt_class) from a change log (batch_id, id, op, gt_label) up to ``batch``.

    Inserts come before deletes and a deletion is for good, also in the batch of the insertion; a known class
    is never deleted. status: ACTIVE, DELETED or GROUND_TRUTH; ids that have not arrived are absent.
    """
    seen = changes.where(F.col("batch_id") <= batch)
    arrived = F.min(F.when(F.col("op") == "insert", F.col("batch_id")))
    gone = F.min(F.when(F.col("op") == "delete", F.col("batch_id")))
    by_id = seen.groupBy("id").agg(arrived.alias("arrived"), gone.alias("gone"), F.max("gt_label").alias("gt_label")).where("arrived is not null")
    status = F.when(F.col("gone").isNotNull(), "DELETED").when(F.col("gt_label").isNotNull(), "GROUND_TRUTH").otherwise("ACTIVE")
    return by_id.select("id", status.alias("status"), gt_class(F.when(F.col("gone").isNull(), F.col("gt_label"))).alias("gt_class"))


def change_log(vertices: DataFrame) -> DataFrame:
    """(batch_id, id, op, gt_label) of vertices."""
    inserts = vertices.where("batch_id is not null").select("batch_id", "id", F.lit("insert").alias("op"), F.col("gt_class").alias("gt_label"))
    deletes = vertices.where("delete_batch is not null").select(F.col("delete_batch").alias("batch_id"), "id", F.lit("delete").alias("op"), F.lit(None).cast("int").alias("gt_label"))
    return inserts.unionByName(deletes)


def gt_class(label: Column) -> Column:
    """Class of a known label: under one half 0, else 1; unknown stays null."""
    return F.when(label.isNull(), None).when(label < 0.5, 0).otherwise(1)


def lifetime(since: Column) -> tuple[Column, Column]:
    """The batch that activates an edge and the one that ends it (null: none), from its ends' life spans (src_in, src_out, dst_in, dst_out) and the batch it came with itself."""
    starts = F.when(F.col("src_in").isNotNull() & F.col("dst_in").isNotNull(), F.greatest("src_in", "dst_in", since))
    return starts, F.least("src_out", "dst_out")


def timeline(graph: Graph, many: bool = False) -> DataFrame:
    """(src, dst, w, starts, ends): edges with the batch that activates them and the one that ends them (null: none).

    The graph's own lines may also say born, the batch of the earlier end, and free, whether no end has a known class. With ``many``
    vertices neither they nor the edges are broadcast.
    """
    if graph.lines is not None:
        return graph.lines
    vertices = graph.vertices.hint("merge") if many else graph.vertices
    span = lambda end: vertices.select(F.col("id").alias(end), F.col("batch_id").alias(f"{end}_in"), F.col("delete_batch").alias(f"{end}_out"))
    both = graph.edges.join(span("src"), "src").join(span("dst"), "dst")
    starts, ends = lifetime(F.col("since") if "since" in graph.edges.columns else F.lit(None).cast("int"))
    return both.select("src", "dst", "w", starts.alias("starts"), ends.alias("ends"))


def edge_activation(graph: Graph) -> DataFrame:
    """(src, dst, w, batch_id): each edge with the later of its endpoints' batches."""
    return timeline(graph).where("starts is not null").select("src", "dst", "w", F.col("starts").alias("batch_id"))


def active(batch: int) -> Column:
    """Of edges: both ends live in ``batch``."""
    return (F.col("starts") <= batch) & (F.col("ends").isNull() | (F.col("ends") > batch))


def active_edges(lines: DataFrame, batch: int) -> DataFrame:
    """(src, dst, w) with both ends live in ``batch``."""
    return lines.where(active(batch)).select("src", "dst", "w")


def new_edges(lines: DataFrame, batch: int) -> DataFrame:
    """Active edges that ``batch`` activates."""
    return lines.where((F.col("starts") == batch) & (F.col("ends").isNull() | (F.col("ends") > batch))).select("src", "dst", "w")


def cut_edges(lines: DataFrame, batch: int) -> DataFrame:
    """Edges that the deletions of ``batch`` end, those that only just arrived included."""
    return lines.where((F.col("starts") <= batch) & (F.col("ends") == batch)).select("src", "dst", "w")


def cleaned_edges(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Directed rows (id, nbr, w) without those that touch a deleted id."""
    return edges.join(deleted.select("id"), "id", "left_anti").join(deleted.select(F.col("id").alias("nbr")), "nbr", "left_anti").select("id", "nbr", "w")


def adjacency(edges: DataFrame, *carry: str) -> DataFrame:
    """(id, nbr, w) and the columns ``carry``: every edge in both directions, from one pass over the edges."""
    ways = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr")))
    return edges.select(F.explode(ways).alias("way"), "w", *carry).select("way.id", "way.nbr", "w", *carry)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) of vertices with an edge."""
    return adjacency(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def auto_tau(edges: DataFrame) -> float:
    """Mean weight, 0.5 without edges."""
    return edges.agg(F.coalesce(F.avg("w"), F.lit(0.5)).alias("tau")).first()["tau"]


def batch_taus(lines: DataFrame, batches: int) -> DataFrame:
    """(batch_id, weight, edges, tau) of every batch: sums over its active edges and their mean weight, 0.5 without edges; one pass over ``lines``.

    An edge adds its weight where it starts and takes it away where it ends; running sums over the batches, a row each, do the rest.
    """
    kind = lines.schema["w"].dataType
    events = F.array(F.struct(F.col("starts").alias("batch_id"), F.col("w"), F.lit(1).alias("n")), F.struct(F.col("ends").alias("batch_id"), (-F.col("w")).alias("w"), F.lit(-1).alias("n")))
    ever = lines.where("starts is not null and (ends is null or ends > starts)")
    changes = ever.select(F.explode(events).alias("x")).select("x.*").groupBy("batch_id").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    every = lines.sparkSession.range(batches).select(F.col("id").cast("int").alias("batch_id")).join(changes, "batch_id", "left")
    until = W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = every.select("batch_id", F.sum(F.coalesce("w", F.lit(0))).over(until).cast(kind).alias("weight"), F.sum(F.coalesce("n", F.lit(0))).over(until).alias("edges"))
    return sums.withColumn("tau", F.coalesce(F.try_divide(F.col("weight"), F.col("edges")), F.lit(0.5)))


def open_vertices(vertices: DataFrame, batch: int) -> DataFrame:
    """(id): live vertices without a known class, the ones that propagation may change."""
    return vertices.where(live(batch) & F.col("gt_class").isNull()).select("id")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def deletion_affected(lines: DataFrame, vertices: DataFrame, batch: int) -> DataFrame:
    """(id): live vertices without a known class that lose a neighbour in ``batch``."""
    return endpoints(cut_edges(lines, batch)).join(open_vertices(vertices, batch), "id", "left_semi")
