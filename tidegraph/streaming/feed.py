"""Batches as files of a stream: changes of vertices and edges may come in any number of files, in any order of their batches.

Every arriving piece is upserted into what is kept of vertices and edges (``kept``), and labels live in versioned Parquet: batch=b holds the labels after b. A piece brings up to
date every version from its first batch on, starting from the newest version before it, so a batch that comes in several files, late or
after a gap ends in the same labels as all changes at once. An edge may come before its ends, which it then waits for, or after them. A piece
that is replayed overwrites itself and, once its versions are complete, does nothing; so a restart is safe. A piece costs what it changes, its neighbourhood
and the batches it redoes, not the log. ``changes/`` keeps the pieces as they came; nothing reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegraph.plans.engine import Engine
from tidegraph.schemas import Graph
from tidegraph.storage import scratch
from tidegraph.streaming.kept import Kept, exists, file_at, taken_in

#: Rows of vertices (op insert or delete, with id) and of edges (op edge, with src, dst and w).
CHANGES = "batch_id int, id long, op string, gt_label int, true_label int, src long, dst long, w double"


def in_form(changes: DataFrame) -> DataFrame:
    """``changes`` with all columns of CHANGES, missing ones null."""
    fields = [c.split() for c in CHANGES.split(", ")]
    return changes.select(*[(F.col(c) if c in changes.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])


def apply(spark: SparkSession, changes: DataFrame, edges: DataFrame | None, state: str, piece: str, **options) -> list[int]:
    """Take in the changes of ``piece``; returns the batches whose versions were written, none if it was taken in before. ``edges``: those known from the start."""
    done = f"{state}/done/{piece}"
    if exists(spark, done):
        return []
    in_form(changes).write.mode("overwrite").parquet(f"{state}/changes/piece={piece}")
    rows = spark.read.schema(CHANGES).parquet(f"{state}/changes/piece={piece}")
    with scratch():
        kept, first = Kept.at(spark, state), rows.agg(F.min("batch_id")).first()[0]
        if piece not in kept.manifest["pieces"]:
            kept, first = taken_in(spark, state, piece, rows, edges)
            old = kept.merge(piece)
            kept.commit()
            for path in old:
                files, where = file_at(spark, path)
                files.delete(where, True)
        numbers = kept.manifest["batches"]
        before = [b for b in numbers if first is not None and b < first and exists(spark, f"{state}/batch={b}/_SUCCESS")]
        after = [b for b in numbers if first is not None and b >= first]
        engine = Engine(Graph(kept.vertices(), kept.edges()), ways=kept.ways(), **options) if after else None
        if before:
            engine.labels = spark.read.parquet(f"{state}/batch={before[-1]}")
        for b in after:
            engine.process_batch(b).write.mode("overwrite").parquet(f"{state}/batch={b}")
    files, where = file_at(spark, done)
    files.create(where).close()
    return after


def process(spark: SparkSession, changes: DataFrame, edges: DataFrame | None, state: str, batch: int, **options) -> None:
    """Take in the changes of ``batch`` as one piece; nothing to do if there are none or they were taken in before."""
    rows = changes.where(F.col("batch_id") == batch)
    if not rows.isEmpty():
        apply(spark, rows, edges, state, f"batch-{batch}", **options)


def follow(spark: SparkSession, incoming: str, edges: DataFrame | None, state: str, **options) -> StreamingQuery:
    """Take in every change file now in ``incoming`` (oldest first), then end; start again for later ones.

    The stream's progress is part of ``state``: pieces are named by its micro-batches, so both are kept or removed together.
    """
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(incoming)

    def each(rows: DataFrame, epoch: int) -> None:
        apply(spark, rows, edges, state, f"epoch-{epoch}", **options)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{state}/progress").trigger(availableNow=True).start()
