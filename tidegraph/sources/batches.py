"""Arrival and deletion batches for a labelled graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegraph.config import RunConfig
from tidegraph.functions.numeric import hashed
from tidegraph.schemas import Graph
from tidegraph.sources.generate import ranked, ranked_within
from tidegraph.storage import materialize


def initial_gt(labels: DataFrame, total: int, order: list) -> DataFrame:
    """(id, gt_class): total div 2 vertices of each class, the first in ``order`` (stratified)."""
    return ranked_within(labels, "true_label", order, "__rank").where(F.col("__rank") < total // 2).select("id", F.col("true_label").alias("gt_class"))


def batch_assign(rest: DataFrame, n: int, num_batches: int, order: list) -> DataFrame:
    """(id, batch_id): ``rest`` (n rows) in equal parts over batches 1 .. num_batches - 1, the first parts one larger."""
    parts = num_batches - 1
    if parts < 1:
        return rest.select("id", F.lit(None).cast("int").alias("batch_id"))
    each, more = divmod(n, parts)
    place = F.col("__place")
    large = more * (each + 1)
    batch = F.when(place < large, F.floor(place / F.lit(each + 1))).otherwise(more + F.floor((place - large) / F.lit(max(1, each))))
    return ranked(rest, order, "__place").select("id", (1 + batch).cast("int").alias("batch_id"))


def batch_gt(assigned: DataFrame, fraction: float, order: list) -> DataFrame:
    """(id, batch_id): max(1, size x fraction) vertices of each batch, the first in ``order``."""
    sizes = assigned.groupBy("batch_id").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * fraction)).alias("__k"))
    return ranked_within(assigned, "batch_id", order, "__rank").join(sizes, "batch_id").where("__rank < __k").select("id", "batch_id")


#: Vertices of a block of ``deletions``.
DELETION_BLOCK = 1 << 16


def earliest(free: list[int], arrived: dict[int, int]) -> None:
    """Takes the earliest free places from their arrival on for all who ``arrived`` (batch: how many); whose turn it is does not change which places are taken."""
    for b, many in sorted(arrived.items()):
        while many and b < len(free):
            taken = min(many, free[b])
            free[b], many, b = free[b] - taken, many - taken, b + 1


def deletions(vertices: DataFrame, fraction: float, num_batches: int, order: list) -> DataFrame:
    """(id, delete_batch): after each batch's arrivals floor(arrivals x fraction) living vertices without a known class go, the first in ``order``.

    Going through all vertices in ``order``, each takes the earliest place that is free from its arrival on. How many places a block of
    them takes from each batch follows from its arrivals alone. So the places that are left for each block come from counts (a row a
    block and batch, on the driver), and every block then deals its own in a task: the number of jobs does not depend on the batches.
    """
    places = [0] * num_batches
    for r in vertices.where(F.col("batch_id").between(1, num_batches - 1)).groupBy("batch_id").count().collect():
        places[r["batch_id"]] = int(r["count"] * fraction)
    can = vertices.where((F.col("batch_id") < num_batches) & F.col("gt_class").isNull()).select("id", F.greatest("batch_id", F.lit(1)).cast("int").alias("__in"), *[F.struct(*order).alias("__order")])
    placed = ranked(can, ["__order"], "__place").withColumn("block", F.floor(F.col("__place") / DELETION_BLOCK).cast("long"))
    counts: dict[int, dict[int, int]] = {}
    for r in placed.groupBy("block", "__in").count().collect():
        counts.setdefault(r["block"], {})[r["__in"]] = r["count"]
    left, free = [], places
    for block in sorted(counts):
        if not any(free):
            break
        left.append((block, list(free)))
        earliest(free, counts[block])
    spark = vertices.sparkSession
    open_ = spark.createDataFrame(left, "block long, free array<int>")

    def deal(rows):
        import pandas as pd

        rows = rows.sort_values("__place")
        free, out = list(rows["free"].iloc[0]), []
        for id_, b in zip(rows["id"], rows["__in"]):
            while b < len(free) and not free[b]:
                b += 1
            if b < len(free):
                free[b] -= 1
                out.append((id_, b))
        return pd.DataFrame(out, columns=["id", "delete_batch"])

    return placed.join(F.broadcast(open_), "block").select("block", "id", "__in", "__place", "free").groupBy("block").applyInPandas(deal, "id long, delete_batch int")


def gen_batches(labels: DataFrame, edges: DataFrame, config: RunConfig) -> Graph:
    """The graph with arrival, deletion and known classes of its vertices, by hashed order."""
    if config.num_batches < 1:
        raise ValueError("num_batches must be over 0")
    seed = config.seed + 12345
    by = lambda what: [hashed(F.col("id"), seed, what), F.col("id")]
    n = labels.count()
    first = materialize(initial_gt(labels, max(2, int(n * config.ground_truth_fraction)), by("start")))
    rest = labels.join(first, "id", "left_anti").select("id").withColumn("__h", by("batch")[0])
    assigned = materialize(batch_assign(rest, n - first.count(), config.num_batches, ["__h", "id"]))
    known = batch_gt(assigned.where("batch_id is not null"), config.ground_truth_fraction, by("known")).select("id", F.lit(True).alias("__known"))
    placed = assigned.join(known, "id", "left").join(labels, "id").select("id", "true_label", "batch_id", F.when(F.col("__known"), F.col("true_label")).alias("gt_class"))
    start = first.join(labels, "id").select("id", "true_label", F.lit(0).alias("batch_id"), "gt_class")
    vertices = materialize(start.unionByName(placed))
    gone = deletions(vertices, config.deleted_fraction, config.num_batches, by("gone"))
    out = vertices.join(gone, "id", "left").select("id", "true_label", F.col("batch_id").cast("int").alias("batch_id"), "delete_batch", "gt_class")
    return Graph(materialize(out), edges)


def batch_summary(graph: Graph) -> DataFrame:
    """(batch_id, inserted, known, deleted, new_edges): counts of each batch."""
    from tidegraph.operators.state import timeline

    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    v = graph.vertices
    rows = v.where("batch_id is not null").select(F.col("batch_id"), F.lit(1).alias("inserted"), F.col("gt_class").isNotNull().cast("int").alias("known"), F.lit(0).alias("deleted"), F.lit(0).alias("new_edges"))
    rows = rows.unionByName(v.where("delete_batch is not null").select(F.col("delete_batch").alias("batch_id"), F.lit(0).alias("inserted"), F.lit(0).alias("known"), F.lit(1).alias("deleted"), F.lit(0).alias("new_edges")))
    rows = rows.unionByName(timeline(graph).where("starts is not null").select(F.col("starts").alias("batch_id"), F.lit(0).alias("inserted"), F.lit(0).alias("known"), F.lit(0).alias("deleted"), F.lit(1).alias("new_edges")))
    return rows.groupBy("batch_id").agg(*map(zero, ("inserted", "known", "deleted", "new_edges")))
