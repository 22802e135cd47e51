"""Predictions, accuracy, the full recompute and run summaries."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window as W, functions as F

from tidegraph.functions.numeric import DOUBLE, Numeric
from tidegraph.operators import state as S
from tidegraph.operators.propagate import MAX_SWEEPS, Propagated, full_propagation
from tidegraph.schemas import Graph


def predictions(labels: DataFrame, numeric: Numeric = DOUBLE) -> DataFrame:
    """(id, predicted): 1 from one half up."""
    return labels.select("id", (F.col("f") >= numeric.lit(numeric.half)).cast("int").alias("predicted"))


def accuracy(labels: DataFrame, vertices: DataFrame, batch: int, numeric: Numeric = DOUBLE) -> DataFrame:
    """(scored, correct, accuracy) over live vertices without a known class; 1.0 if there are none."""
    open_ = vertices.where(S.live(batch) & F.col("gt_class").isNull()).select("id", "true_label")
    scored = open_.join(predictions(labels, numeric), "id")
    correct = F.coalesce(F.sum((F.col("predicted") == F.col("true_label")).cast("long")), F.lit(0).cast("long"))
    return scored.agg(F.count(F.lit(1)).alias("scored"), correct.alias("correct")).select(
        "scored", "correct", F.when(F.col("scored") == 0, 1.0).otherwise(F.col("correct") / F.when(F.col("scored") == 0, 1).otherwise(F.col("scored"))).alias("accuracy")
    )


def accuracy_by_batch(history: DataFrame, vertices: DataFrame, batches: int, numeric: Numeric = DOUBLE) -> DataFrame:
    """(batch_id, scored, correct, accuracy) of every batch as ``accuracy`` has them, from labels over time (id, f, starts, ends); one join and one aggregation.

    A label counts while its vertex lives: it adds to its first such batch and takes away where it ends; running sums over the batches, a row each, do the rest.
    """
    # A row a vertex: by shuffles.
    v = vertices.where("gt_class is null").select("id", "true_label", "batch_id", "delete_batch").hint("merge")
    at = predictions(history.withColumn("id", F.struct("id", "starts", "ends")), numeric).select("id.*", "predicted").join(v, "id")
    spans = at.select(F.greatest("starts", "batch_id").alias("a"), F.least("ends", "delete_batch").alias("b"), (F.col("predicted") == F.col("true_label")).cast("long").alias("right")).where("b is null or a < b")
    events = F.array(F.struct(F.col("a").alias("batch_id"), F.lit(1).cast("long").alias("n"), F.col("right")), F.struct(F.col("b").alias("batch_id"), F.lit(-1).cast("long").alias("n"), (-F.col("right")).alias("right")))
    changes = spans.select(F.explode(events).alias("x")).select("x.*").groupBy("batch_id").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    every = vertices.sparkSession.range(batches).select(F.col("id").cast("int").alias("batch_id")).join(changes, "batch_id", "left")
    until = W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = every.select("batch_id", *[F.sum(F.coalesce(c, F.lit(0).cast("long"))).over(until).alias(to) for c, to in (("n", "scored"), ("right", "correct"))])
    return sums.withColumn("accuracy", F.when(F.col("scored") == 0, 1.0).otherwise(F.try_divide(F.col("correct"), F.col("scored"))))


def final_status(vertices: DataFrame, last_batch: int) -> DataFrame:
    """(id, status, gt_class) after all batches."""
    return S.vertex_status(S.change_log(vertices), last_batch)


def recompute(graph: Graph, batch: int, delta: float = 1e-4, max_iterations: int = MAX_SWEEPS, numeric: Numeric = DOUBLE) -> tuple[Propagated, float]:
    """The full recompute on the graph of ``batch`` and its time in ms."""
    began = time.perf_counter()
    by_cells = numeric.fixed and graph.cells is not None
    adj = graph.cells.where(S.active(batch)) if by_cells else S.adjacency(S.active_edges(S.timeline(graph), batch))
    result = full_propagation(adj, graph.vertices.where(S.live(batch)), delta, max_iterations, numeric)
    return result, (time.perf_counter() - began) * 1000


def run_summary(metrics: DataFrame, baseline_ms: float | None = None) -> DataFrame:
    """(batches, total_ms, mean_accuracy, final_accuracy, speedup): speedup compares one recompute with all batches together."""
    out = metrics.agg(F.count(F.lit(1)).alias("batches"), F.sum("time_ms").alias("total_ms"), F.avg("accuracy").alias("mean_accuracy"), F.max_by("accuracy", "batch_id").alias("final_accuracy"))
    speedup = F.lit(baseline_ms).cast("double") / F.nullif(F.col("total_ms"), F.lit(0.0))
    return out.withColumn("speedup", speedup)
