"""Synthetic graphs from hashes of ids and a seed: the same rows under any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidegraph.functions.numeric import hashed, uniform
from tidegraph.storage import materialize


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with the 0-based rank of each row in ``order`` as ``name``, without one task seeing all rows.

    Rows are range-partitioned, ranked within partitions and shifted by the sizes of the partitions before.
    """
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, inner = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__start"))
    return placed.withColumn("__p", part).join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + inner).drop("__p", "__at", "__start")


def ranked_within(df: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """``df`` with the 0-based rank of each row within its ``group`` (of which there are few) as ``name``, by one range partitioning."""
    placed = ranked(df, [F.col(group), *order], name)
    first = placed.groupBy(F.col(group).alias("__g")).agg(F.min(name).alias("__first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("__g"))).withColumn(name, F.col(name) - F.col("__first")).drop("__g", "__first")


def gen_labels(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(id, true_label): half of the vertices 0 (rounded down), the rest 1, by a shuffled order."""
    ids = spark.range(n).withColumn("h", hashed(F.col("id"), seed))
    return ranked(ids, ["h", "id"], "place").select("id", (F.col("place") >= n // 2).cast("int").alias("true_label"))


def gen_backbone(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(src, dst): n - 1 edges of a random path through all vertices."""
    ids = spark.range(n).withColumn("h", hashed(F.col("id"), seed + 1))
    order = materialize(ranked(ids, ["h", "id"], "place").select("id", "place"))
    following = order.select(F.col("id").alias("other"), (F.col("place") - 1).alias("place"))
    return order.join(following, "place").select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"))


def all_pairs(spark: SparkSession, n: int) -> DataFrame:
    """(src, dst): every pair of different vertices."""
    return spark.range(n - 1).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("dst"))


def gen_edges(spark: SparkSession, n: int, degree: int, seed: int = 42) -> DataFrame:
    """(src, dst): max(n degree div 2, n - 1) different edges without loops, the backbone among them; every pair there is if those are fewer.

    Candidates are hashed pairs; each round draws more than are missing, drops what is known and keeps the first by hash. As long as
    at least half of all pairs are free, half of the draws are new and the rounds end soon; for more edges than that, all pairs are the candidates.
    """
    pairs = n * (n - 1) // 2
    target = min(max(n * degree // 2, n - 1), pairs)
    edges, have, round_ = materialize(gen_backbone(spark, n, seed)), n - 1, 0
    while have < target:
        if 2 * target > pairs:
            fresh = all_pairs(spark, n)
        else:
            draws = spark.range(int((target - have) * 1.3) + 64 * (1 + round_))
            a, b = (hashed(F.col("id"), seed + 2 + round_, end) % n for end in ("a", "b"))
            fresh = draws.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where("src < dst").distinct()
        fresh = fresh.join(edges, ["src", "dst"], "left_anti").withColumn("h", hashed(F.col("src"), F.col("dst"), seed))
        chosen = ranked(fresh, ["h", "src", "dst"], "place").where(F.col("place") < target - have)
        edges = materialize(edges.unionByName(chosen.select("src", "dst")))
        have, round_ = edges.count(), round_ + 1
    return edges


def gen_weights(edges: DataFrame, labels: DataFrame, seed: int = 42) -> DataFrame:
    """(src, dst, w): uniform in [0.5, 1) inside a class and in [0.01, 0.5) between classes."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("true_label").alias(f"{end}_label"))
    u = uniform(F.col("src"), F.col("dst"), seed, "w")
    w = F.when(F.col("src_label") == F.col("dst_label"), 0.5 + 0.5 * u).otherwise(0.01 + 0.49 * u)
    return edges.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", w.alias("w"))


def gen_graph(spark: SparkSession, n: int, degree: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(labels, edges) of a connected graph."""
    if n < 2 or degree <= 0:
        raise ValueError("a graph needs two vertices and a positive degree")
    labels = materialize(gen_labels(spark, n, seed))
    return labels, materialize(gen_weights(gen_edges(spark, n, degree, seed), labels, seed))
