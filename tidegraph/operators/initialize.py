"""Starting labels of newly arrived vertices, by component."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegraph.functions.numeric import DOUBLE, FIXED, LABEL, Numeric
from tidegraph.operators.cells import Cells


def supernode_weights(components: DataFrame, adj: DataFrame, known: DataFrame) -> DataFrame:
    """(root, w0, w1): weight of each component (id, root) to known vertices (id, gt_class) of either class.

    All active edges count, weak ones and those to or from known members too. ``adj`` has every edge in both directions.
    """
    return component_weights(components, adj.join(known.select("id", "gt_class"), "id"))


def component_weights(components: DataFrame, near: DataFrame) -> DataFrame:
    """``supernode_weights`` from the directed edges of the known vertices with their classes, ``near`` (id, nbr, w, gt_class): sums a neighbour before they meet its component."""
    side = lambda k: F.coalesce(F.sum(F.when(F.col("gt_class") == k, F.col("w"))), F.lit(0)).alias(f"w{k}")
    return weights_of(components, near.groupBy(F.col("nbr").alias("id")).agg(side(0), side(1)))


def weights_by_cells(components: DataFrame, cells: Cells, alive: DataFrame) -> DataFrame:
    """``supernode_weights`` in fixed point, over the live vertices ``alive`` (id, gt_class)."""
    sums = cells.sums(alive, FIXED.class_label(F.col("gt_class")), F.lit(False), [])
    w1 = (F.col("part") / LABEL).cast("long")
    return weights_of(components, sums.select("id", (F.col("whole") - w1).alias("w0"), w1.alias("w1")).hint("merge"))


def weights_of(components: DataFrame, sums: DataFrame) -> DataFrame:
    """``supernode_weights`` from those of each vertex (id, w0, w1)."""
    return components.select("id", "root").join(sums, "id").groupBy("root").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))


def label_init(components: DataFrame, weights: DataFrame, known: DataFrame, numeric: Numeric = DOUBLE) -> DataFrame:
    """(id, f): a known vertex its class, another w1 / (w0 + w1) of its component, one half without weight."""
    joined = components.select("id", "root").join(weights, "root", "left").join(known.select("id", "gt_class"), "id", "left")
    w0, w1 = F.coalesce("w0", F.lit(0)), F.coalesce("w1", F.lit(0))
    part = w1.cast("decimal(28,0)") * numeric.one if numeric.fixed else w1
    share = numeric.ratio(part, w0 + w1, numeric.lit(numeric.half))
    return joined.select("id", F.coalesce(numeric.class_label(F.col("gt_class")), share).alias("f"))
