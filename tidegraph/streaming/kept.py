"""Vertices and edges of a stream, kept between its pieces and changed by upserts.

Three tables lie under ``kept/``: spans (a row a vertex that was ever named), ways (the directed edges with loops and with the batches they live in, in buckets by
their pulling end) and pending (edges of which an end has not arrived, by that end). Each is a base with a run of changed rows a piece on top; the newest row of
a key counts. A piece reads the spans, the pending edges and the ways of the vertices that it changes, and writes a run of the rows that change: what it names, and the
edges next to it. Runs are merged into a new base once there are ``MERGE`` of them, or once they hold a ``SHARE`` of the base.

What counts is named by a manifest, which is written last: a piece that fails half-way leaves the one before it in force and can be taken in again.

Defined cases. A vertex may be deleted before it arrives, in the order of the pieces; the earliest arrival and deletion count. An edge comes in either direction; a loop is left out. An edge
that comes again has its newest weight and its earliest batch. An edge comes into force with the last of its ends and itself.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from tidegraph.operators import state as S
from tidegraph.operators.propagate import Placed, place
from tidegraph.storage import buckets_at

MERGE, SHARE = 8, 0.2
SPANS = ["id", "true_label", "batch_id", "delete_batch", "gt_class"]
WAYS = ["id", "nbr", "w", "since", "starts", "ends"]
KEYS = {"spans": ["id"], "ways": ["id", "nbr"], "pending": ["src", "dst"]}


def file_at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = file_at(spark, path)
    return files.exists(where)


@dataclass
class Kept:
    """What is kept under ``root``, as of a manifest: for each table its base and runs as [path, rows], and the buckets of ways."""

    spark: SparkSession
    root: str
    manifest: dict

    @classmethod
    def at(cls, spark: SparkSession, state: str) -> Kept:
        root = f"{state}/kept"
        path = f"{root}/manifest"
        empty = {"pieces": [], "batches": [], "tables": {name: [] for name in KEYS}, "schemas": {}, "buckets": None}
        if not exists(spark, path):
            return cls(spark, root, empty)
        files, where = file_at(spark, path)
        newest = max(int(s.getPath().getName()) for s in files.listStatus(where) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        return cls(spark, root, json.loads(spark.read.text(f"{path}/{newest}").first()[0]))

    def commit(self) -> None:
        """The manifest is one row of text; from now on it counts."""
        self.spark.createDataFrame([(json.dumps(self.manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/{len(self.manifest['pieces'])}")

    def schema(self, name: str, more: str = "gone") -> T.StructType:
        """The columns of a table's runs; ``more`` stands for the base's last one."""
        fields = [f for f in T.StructType.fromJson(self.manifest["schemas"][name]).fields if f.name != "gone"]
        return T.StructType([*fields, *{"gone": [T.StructField("gone", T.BooleanType())], "salt": [T.StructField("salt", T.IntegerType())], "": []}[more]])

    def overlay(self, name: str) -> DataFrame | None:
        """The newest row of each key in the runs, those that took a row away included."""
        every, keys = None, KEYS[name]
        for k, (path, _) in enumerate(self.manifest["tables"][name][1:]):
            one = self.spark.read.schema(self.schema(name)).parquet(path).withColumn("run", F.lit(k))
            every = one if every is None else every.unionByName(one)
        if every is None:
            return None
        rest = [c for c in every.columns if c not in (*keys, "run")]
        return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "run").alias("row")).select(*keys, "row.*")

    def base(self, name: str) -> DataFrame | None:
        tables = self.manifest["tables"][name]
        if not tables:
            return None
        if name == "ways":
            n, columns = self.manifest["buckets"]
            return buckets_at(self.spark, f"{tables[0][0]}/ways", n, columns, self.schema(name, "salt"))
        return self.spark.read.schema(self.schema(name, "")).parquet(tables[0][0])

    def current(self, name: str) -> DataFrame | None:
        base, over = self.base(name), self.overlay(name)
        if base is None or over is None:
            return base
        # Runs are a bounded share of the base: what they replace goes, without a shuffle of the base where they are small enough to broadcast.
        return base.join(over.select(*KEYS[name]), KEYS[name], "left_anti").select(*base.columns).unionByName(over.where("not gone").select(*[c for c in base.columns if c in over.columns]), allowMissingColumns=True)

    def ways(self) -> Placed:
        """The directed edges as an engine takes them."""
        path = self.manifest["tables"]["ways"][0][0]
        rows = sum(n for _, n in self.manifest["tables"]["ways"])
        pieces = self.spark.read.schema("id long, pieces int").parquet(f"{path}/pieces") if len(self.manifest["buckets"][1]) > 1 else None
        return Placed(self.current("ways").withColumn("salt", F.coalesce("salt", F.lit(0))), rows, pieces, self.manifest["buckets"][0])

    def vertices(self) -> DataFrame:
        return self.current("spans").where("batch_id is not null").select(*SPANS)

    def edges(self) -> DataFrame:
        """(src, dst, w) of all edges, pending ones too."""
        there = self.current("ways").where("id < nbr").select(F.col("id").alias("src"), F.col("nbr").alias("dst"), "w")
        waiting = self.current("pending")
        return there if waiting is None else there.unionByName(waiting.select("src", "dst", "w"))

    def push(self, name: str, rows: DataFrame, piece: str) -> DataFrame:
        """Write ``rows`` (with ``gone``) as a run of ``piece``; returns it."""
        path, seen = f"{self.root}/{name}/{piece}", Observation()
        rows = rows.select(*[c for c in rows.columns if c != "gone"], "gone")
        self.manifest["schemas"][name] = rows.schema.jsonValue()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        tables = self.manifest["tables"][name]
        if not tables:
            # The first run is the base.
            made = self.spark.read.schema(rows.schema).parquet(path)
            self.settle(name, made.where("not gone").drop("gone"), piece, seen.get["n"])
            return made
        if seen.get["n"]:
            tables.append([path, seen.get["n"]])
        return self.spark.read.schema(rows.schema).parquet(path)

    def settle(self, name: str, rows: DataFrame, piece: str, n: int) -> None:
        """``rows`` become the base of ``name``."""
        path = f"{self.root}/{name}/base-{piece}"
        if name == "ways":
            placed = place(rows.select(*WAYS), path)
            self.manifest["buckets"] = [placed.buckets, ["id"] if placed.pieces is None else ["id", "salt"]]
        else:
            rows.write.mode("overwrite").parquet(path)
        self.manifest["tables"][name] = [[path, n]]

    def merge(self, piece: str) -> list[str]:
        """Merge the runs of tables that have too many; returns the folders that no longer count, to be removed after the commit."""
        old = []
        for name, tables in self.manifest["tables"].items():
            rows = sum(n for _, n in tables)
            if len(tables) > MERGE or (len(tables) > 1 and rows - tables[0][1] > SHARE * tables[0][1]):
                old += [path for path, _ in tables]
                self.settle(name, self.current(name), piece, rows)
        return old


def taken_in(spark: SparkSession, state: str, piece: str, changes: DataFrame, edges: DataFrame | None) -> tuple[Kept, int | None]:
    """What is kept after ``changes`` (vertex and edge rows) and, as the first piece, the ``edges`` known from the start; and the first batch that they touch.

    Nothing counts until the manifest is committed.
    """
    kept = Kept.at(spark, state)
    named = changes.where("op in ('insert', 'delete') and id is not null")
    at = lambda op: F.min(F.when(F.col("op") == op, F.col("batch_id")))
    new = named.groupBy("id").agg(F.max("true_label").alias("true_label"), at("insert").alias("batch_id"), at("delete").alias("delete_batch"), F.max(F.when(F.col("op") == "insert", F.col("gt_label"))).alias("gt_class"))
    if (before := kept.current("spans")) is not None:
        old = before.select("id", *[F.col(c).alias(f"old_{c}") for c in SPANS[1:]])
        earliest, largest = (lambda c: F.least(c, f"old_{c}")), (lambda c: F.greatest(c, f"old_{c}"))
        both = new.join(old, "id", "left")
        merged = {"true_label": largest("true_label"), "batch_id": earliest("batch_id"), "delete_batch": earliest("delete_batch"), "gt_class": largest("gt_class")}
        other = [~merged[c].eqNullSafe(F.col(f"old_{c}")) for c in merged]
        changed = both.where(other[0] | other[1] | other[2] | other[3]).select("id", *[merged[c].alias(c) for c in SPANS[1:]])
    else:
        changed = new
    changed = kept.push("spans", changed.withColumn("gone", F.lit(False)), piece)
    spans = kept.current("spans")

    kind = edges.schema["w"].dataType.simpleString() if edges is not None else "double"
    came = changes.where("op = 'edge' and src != dst").select("src", "dst", F.col("w").cast(kind).alias("w"), F.col("batch_id").alias("since"))
    if edges is not None and not kept.manifest["pieces"]:
        came = edges.select("src", "dst", "w", F.lit(None).cast("int").alias("since")).unionByName(came)
    # One row an edge: its newest weight; known from the start, or else from its earliest batch.
    order = F.coalesce("since", F.lit(-1))
    came = came.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max_by("w", order).alias("w"), F.min(order).alias("first"))
    waiting = kept.current("pending")
    moved = changed.where("batch_id is not null").select("id")
    if waiting is not None:
        woken = waiting.join(moved.withColumnRenamed("id", "missing"), "missing", "left_semi").select("src", "dst", "w", "first", F.lit(0).alias("age"))
        again = waiting.join(came.select("src", "dst"), ["src", "dst"], "left_semi").select("src", "dst", "w", "first", F.lit(0).alias("age"))
        came = came.withColumn("age", F.lit(1)).unionByName(woken).unionByName(again).groupBy("src", "dst").agg(F.max_by("w", "age").alias("w"), F.min("first").alias("first"))
    lines = came.withColumn("age", F.lit(1))
    if (there := kept.current("ways")) is not None:
        # Edges in force that this piece names again, or whose ends it changes.
        plain = there.where("id != nbr").select("id", "nbr", "w", F.coalesce("since", F.lit(-1)).alias("first"))
        near = plain.join(changed.select("id"), "id", "left_semi").select(F.least("id", "nbr").alias("src"), F.greatest("id", "nbr").alias("dst"), "w", "first")
        known = plain.where("id < nbr").withColumnsRenamed({"id": "src", "nbr": "dst"}).join(came.select("src", "dst"), ["src", "dst"], "left_semi").select("src", "dst", "w", "first")
        lines = lines.unionByName(near.unionByName(known).withColumn("age", F.lit(0)))
    lines = lines.groupBy("src", "dst").agg(F.max_by("w", "age").alias("w"), F.min("first").alias("first"))
    span = lambda end: spans.where("batch_id is not null").select(F.col("id").alias(end), F.col("batch_id").alias(f"{end}_in"), F.col("delete_batch").alias(f"{end}_out"))
    lines = lines.join(span("src"), "src", "left").join(span("dst"), "dst", "left").withColumn("since", F.nullif("first", F.lit(-1)))
    here = F.col("src_in").isNotNull() & F.col("dst_in").isNotNull()
    missing = F.when(F.col("src_in").isNull(), F.col("src")).otherwise(F.col("dst"))
    # An edge that was waiting and now is there leaves a row that takes it away.
    wait = lines.select("src", "dst", "w", "first", missing.alias("missing"), here.alias("gone"))
    kept.push("pending", wait if waiting is None else wait.join(waiting.select("src", "dst", F.lit(True).alias("known")), ["src", "dst"], "left").where("not gone or known").drop("known"), piece)
    starts, ends = S.lifetime(F.col("since"))
    ways = S.adjacency(lines.where(here).select("src", "dst", "w", "since", starts.alias("starts"), ends.alias("ends")), "since", "starts", "ends")
    own = changed.where("batch_id is not null").select("id", F.col("id").alias("nbr"), F.lit(0).cast(kind).alias("w"), F.lit(None).cast("int").alias("since"), F.col("batch_id").alias("starts"), F.col("delete_batch").alias("ends"))
    kept.push("ways", ways.select(*WAYS).unionByName(own).withColumn("gone", F.lit(False)), piece)
    # One row a batch.
    numbers = {r[0] for r in changes.where("batch_id is not null").select("batch_id").distinct().collect()}
    kept.manifest["batches"] = sorted({*kept.manifest["batches"], *numbers})
    kept.manifest["pieces"].append(piece)
    return kept, min(numbers, default=None)
