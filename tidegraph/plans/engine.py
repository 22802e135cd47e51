"""The incremental engine: one call a batch, labels carried from batch to batch."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Window as W, functions as F

from tidegraph.functions.numeric import DOUBLE, Numeric
from tidegraph.operators import state as S
from tidegraph.operators.cells import Cells
from tidegraph.operators.components import components_of_few, connected_components, maintained_components
from tidegraph.operators.initialize import component_weights, label_init, supernode_weights, weights_by_cells
from tidegraph.operators.propagate import BROADCAST_ROWS, MAX_SWEEPS, ROWS_PER_TASK, Placed, loops, place, propagate
from tidegraph.operators.sparsify import insertion_affected, new_vertices, strong_new_edges
from tidegraph.plans.evaluate import accuracy
from tidegraph.schemas import Graph, check
from tidegraph.storage import Table, materialize

METRICS = "batch_id int, time_ms double, accuracy double, iterations int, converged boolean, num_components long, num_sub_edges long"


@dataclass
class Engine:
    """Applies the batches of ``graph`` in order.

    tau None or negative: the mean weight over all edges (``tau_scope`` 'full') or over those active in the batch ('active').
    Labels of deleted vertices stay as they were. With ``freeze_gt_free`` vertices of components without a known
    class take no part in sweeps: they carry no class and may swing for ever. The directed edges are written once, in buckets by their
    pulling end (a hub's in several) and with the batches they live in; the adjacency of a batch is a filter on them that no shuffle moves.
    """

    graph: Graph
    delta: float = 1e-4
    tau: float | None = None
    tau_scope: str = "full"
    seed_mode: str = "strong"
    max_iterations: int = MAX_SWEEPS
    numeric: Numeric = DOUBLE
    freeze_gt_free: bool = False
    #: Whether to look for rows that break the graph's rules before anything else (one job over its tables).
    check: bool = False
    #: Whether to keep labels over time, see ``history``.
    keep: bool = False
    labels: DataFrame | None = None
    #: The directed edges with loops (id, nbr, w, starts, ends), if they are kept already.
    ways: Placed | Cells | None = None
    changes: list[DataFrame] = field(default_factory=list)
    metrics: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        if self.check:
            check(self.graph)
        self.taus: dict[int, float] = {}
        self.regions: tuple[int, DataFrame] | None = None
        self.vertices = self.graph.vertices
        self.many = self.vertices.count() > BROADCAST_ROWS
        if self.ways is not None:
            self.lines = self.ways.df.where("id < nbr").select(F.col("id").alias("src"), F.col("nbr").alias("dst"), "w", "starts", "ends")
        else:
            self.lay_out()
        self.full_tau = S.auto_tau(self.graph.edges) if self.tau is None or self.tau < 0 else self.tau

    def lay_out(self) -> None:
        if self.numeric.fixed and self.graph.cells is not None:
            self.ways, self.lines, self.many = self.graph.cells, self.graph.lines, True
            return
        lines = S.timeline(self.graph, self.many)
        self.lines = lines if lines is self.graph.lines else materialize(lines)
        spans = self.vertices.select("id", F.col("batch_id").alias("starts"), F.col("delete_batch").alias("ends"), F.lit(False).alias("free"))
        carry = [c for c in ("starts", "ends", "free") if c in self.lines.columns]
        ways = S.adjacency(self.lines, *carry)
        self.ways = place(ways.unionByName(loops(spans, ways, *carry)))

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` (a row a vertex) for joins with such tables: by shuffles, as a broadcast passes the driver in every batch, unless vertices are few."""
        return df.hint("merge") if self.many else df

    def batch_tau(self, batch: int):
        automatic = self.tau is None or self.tau < 0
        if not automatic or self.tau_scope != "active":
            return self.full_tau
        if batch not in self.taus:
            # All batches in one pass; twice as many if there are more than thought.
            self.taus = {r.batch_id: r.tau for r in S.batch_taus(self.lines, max(16, 2 * (batch + 1))).collect()}
        return self.taus[batch]

    def process_batch(self, batch: int) -> DataFrame:
        """(id, f) of every vertex that has arrived by ``batch``, after its changes."""
        began = time.perf_counter()
        tau, n = self.batch_tau(batch), self.numeric
        v = self.vertices
        each = self.dealt(v)
        adj = self.ways.where(S.active(batch))
        known = v.where(S.live(batch) & F.col("gt_class").isNotNull()).select("id", "gt_class")
        fresh = new_vertices(each, batch)
        seen = Observation()
        strong = Table(strong_new_edges(self.lines, each, batch, tau).observe(seen, F.count(F.lit(1)).alias("n"))).df
        few = seen.get["n"] <= ROWS_PER_TASK
        components = materialize(components_of_few(strong, fresh)) if few else connected_components(strong, fresh)
        if isinstance(adj, Cells):
            weights = weights_by_cells(self.dealt(components), adj, v.where(S.live(batch)).select("id", "gt_class"))
        elif self.many:
            weights = component_weights(self.dealt(components), adj.beside(known).where("id != nbr"))
        else:
            weights = supernode_weights(components, adj.df.where("id != nbr"), known)
        initial = label_init(components, self.dealt(weights), self.dealt(known), n)
        # Vertices that come and go within the batch still get a row, at one half.
        passing = v.where((F.col("batch_id") == batch) & ~S.live(batch)).select("id", n.lit(n.half).alias("f"))
        arrived = initial.unionByName(passing)
        labels = materialize(arrived if self.labels is None else self.labels.unionByName(arrived))
        seeds = insertion_affected(self.lines, each, batch, tau, self.seed_mode).union(S.deletion_affected(self.lines, each, batch)).distinct()
        if self.freeze_gt_free:
            regions = self.regions_of(batch)
            with_known = regions.join(known, "id").select("root").distinct()
            seeds = seeds.join(regions.join(with_known, "root", "left_semi"), "id", "left_semi")
        alive = labels.join(each.where(S.live(batch)).select("id"), "id", "left_semi")
        result = propagate(adj, alive, self.dealt(known), self.dealt(seeds), self.delta, self.max_iterations, n)
        rest = labels.join(self.dealt(result.labels).select("id"), "id", "left_anti")
        before, self.labels = self.labels, materialize(result.labels.unionByName(rest))
        if self.keep:
            self.remember(before, batch)
        one = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"))
        sizes = components.agg(one("parts", F.countDistinct("root")).alias("x"))
        found = {r.x["name"]: r.x["value"] for r in sizes.union(accuracy(self.labels, each, batch, n).select(one("correct", F.col("accuracy")).alias("x"))).collect()}
        self.metrics.append((batch, (time.perf_counter() - began) * 1000, found["correct"], result.iterations, result.converged, int(found["parts"]), seen.get["n"]))
        return self.labels

    def regions_of(self, batch: int) -> DataFrame:
        """(id, root) over all active edges: carried on from the batch before, made anew where that one was not processed."""
        edges, alive = S.active_edges(self.lines, batch), self.vertices.where(S.live(batch)).select("id")
        if self.regions and self.regions[0] == batch - 1:
            made = maintained_components(self.regions[1], edges, S.new_edges(self.lines, batch), S.cut_edges(self.lines, batch), alive)
        else:
            made = connected_components(edges, alive)
        self.regions = batch, made
        return made

    def remember(self, before: DataFrame | None, batch: int) -> None:
        """Adds the labels that ``batch`` set or changed."""
        now = self.labels
        if before is not None:
            now = now.join(self.dealt(before).select("id", F.col("f").alias("old")), "id", "left").where(~F.col("f").eqNullSafe(F.col("old")))
        self.changes.append(materialize(now.select("id", "f", F.lit(batch).cast("int").alias("starts"))))

    def history(self) -> DataFrame:
        """(id, f, starts, ends): each label with the batches from which and up to which (excluded; null: still) it held."""
        every = self.changes[0]
        for some in self.changes[1:]:
            every = every.unionByName(some)
        return every.withColumn("ends", F.lead("starts").over(W.partitionBy("id").orderBy("starts")))

    def run(self, batches: int) -> DataFrame:
        for b in range(batches):
            self.process_batch(b)
        return self.labels

    def metrics_table(self) -> DataFrame:
        return self.vertices.sparkSession.createDataFrame(self.metrics, METRICS)

    def all_labels(self) -> DataFrame:
        """(id, f) of every vertex, those that never arrived at one half."""
        every = self.vertices.select("id")
        if self.labels is None:
            return every.select("id", self.numeric.lit(self.numeric.half).alias("f"))
        return every.join(self.dealt(self.labels), "id", "left").select("id", F.coalesce("f", self.numeric.lit(self.numeric.half)).alias("f"))
