"""Weighted neighbour averaging over a frontier, and the full sweep of the baseline.

The adjacency lies in buckets of the pulling vertex (``place``), a hub's edges cut into pieces of at most some ``HUB_ROWS``, which lie in buckets of
their own. It holds a row of no weight from each vertex to itself, so a sweep is one join and one aggregation (and a second, of one row a
piece, where there are hubs). Labels come to it by broadcast while the vertices, which are counted, are at most
``BROADCAST_ROWS`` (a broadcast passes the driver in every sweep); then nothing but pieces is shuffled. Beyond, labels go to the buckets of their vertices and from there to the neighbours as
sums, combined in each task before they are shuffled: the adjacency never moves, and labels never pass the driver. A bucket sends at most a sum a vertex, so a dense graph
(``DENSE``) lies in few, larger buckets: what a sweep shuffles follows its vertices, not its edges.

Sweeps run in blocks: one job makes up to ``UNROLL`` of them, each a step of the same plan, and writes the labels after each. It counts the movers of
each sweep, so the run is cut back to the exact sweep that it stops at. A graph that is one task's share in all is swept by one task to the end (``settle``).

On a large graph of which few vertices move, a sweep reads the neighbourhood of the movers only and writes nothing but the rows that it changed, as a run
of a ``LabelLog``: a base with runs on top, read as the newest row of each id and merged every ``MERGE`` runs.

Known vertices never change, so the components that the others form without them do not touch. After ``SPLIT`` sweeps, those components that move and have
at most ``SETTLE_ROWS`` rows are dealt to tasks, which sweep them to the end (``settle_parts``); sweeps over the whole graph go on for larger ones only.

A component without a known class may swing between states for ever. Each sweep's labels and movers have a digest (xor and sum of a hash a vertex,
whatever the order). When one comes up again after p sweeps, the state is held and compared row by row with the one p sweeps later: if both are equal,
what follows repeats with period p, and the run goes on for only as many sweeps as bring it to the state at the cap. Its labels, ``iterations`` and
``converged`` are those of the plain iteration; ``swept`` says how many sweeps were made.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tidegraph.functions.numeric import DOUBLE, Numeric
from tidegraph.operators.cells import Cells
from tidegraph.operators.components import connected_components
from tidegraph.operators.settle import settle, settle_parts
from tidegraph.storage import Buckets, Table

#: Vertices whose labels are broadcast: some 100 KB a sweep.
BROADCAST_ROWS = 1 << 12
#: Directed edges that one task pulls over.
ROWS_PER_TASK = 1 << 16
#: Directed edges a vertex of a graph in few buckets, how many such buckets at least, and rows of one at most.
DENSE, FEW_BUCKETS, MOST_ROWS = 32, 16, 1 << 25
#: Directed edges of a vertex that stay together.
HUB_ROWS = ROWS_PER_TASK >> 5
#: Vertices of a file of the state, and of a graph that is worth runs.
ROWS_PER_FILE = 1 << 17
#: Share of movers under which only their neighbourhood is pulled.
SPARSE = 0.05
#: Runs of a label log until they are merged.
MERGE = 8
#: Sweeps of a job.
UNROLL = 4
#: Sweeps after which components that still move are swept on their own.
SPLIT = 16
#: Directed edges and loops of a component that one task sweeps to the end: some tens of bytes each, and a sweep in memory that is shorter than a job's start.
SETTLE_ROWS = 1 << 22
#: Cap of sweeps, the fixed default of the command line.
MAX_SWEEPS = 100_000


@dataclass
class Propagated:
    labels: DataFrame  # id, f
    iterations: int
    converged: bool
    swept: int = 0
    #: Rows that each job wrote.
    written: list[int] = field(default_factory=list)


def pull(adj: DataFrame, labels: DataFrame, numeric: Numeric) -> DataFrame:
    """(id, part, whole): sums of w f and w over the neighbours."""
    source = labels.select(F.col("id").alias("nbr"), F.col("f").alias("nbr_f"))
    return adj.join(source, "nbr").groupBy("id").agg(numeric.products(F.col("w"), F.col("nbr_f")).alias("part"), F.sum("w").alias("whole"))


def loops(vertices: DataFrame, adj: DataFrame, *carry: str) -> DataFrame:
    """(id, nbr, w) and the columns ``carry``: a row of no weight from each of ``vertices`` to itself."""
    return vertices.select("id", F.col("id").alias("nbr"), F.lit(0).cast(adj.schema["w"].dataType).alias("w"), *carry)


def bucket_count(rows: int, most: int) -> int:
    """Buckets of about ROWS_PER_TASK rows, at most as many as the session allows."""
    return max(1, min(-(-rows // ROWS_PER_TASK), most))


@dataclass
class Placed:
    """Directed edges with ``loops`` (id, nbr, w, salt and more, such as free: whether no end is known), in buckets by id and salt; rows: how many at most, in so many buckets; pieces: (id, pieces) of the hubs, None without hubs."""

    df: DataFrame
    rows: int
    pieces: DataFrame | None = None
    buckets: int = 1

    def where(self, kept: Column) -> Placed:
        return replace(self, df=self.df.where(kept).select("id", "nbr", "w", "salt", *({"free"} & {*self.df.columns})))

    def beside(self, rows: DataFrame) -> DataFrame:
        """The edges joined to ``rows`` (id and more) of their pulling vertices, which go to the buckets: no edge moves, and nothing passes the driver."""
        keys = ["id"] if self.pieces is None else ["id", "salt"]
        if self.pieces is not None:
            each = F.sequence(F.lit(0), F.coalesce(F.col("pieces"), F.lit(1)) - 1)
            rows = rows.join(self.pieces.hint("merge"), "id", "left").withColumn("salt", F.explode(each)).drop("pieces")
        # Dealt to as many parts as there are buckets, or Spark may deal the edges to the parts of the rows; a bucket's own vertices are few, so they are hashed there.
        return self.df.join(rows.repartition(self.buckets, *keys).hint("shuffle_hash"), keys)


def place(ways: DataFrame, path: str | None = None) -> Placed:
    """``ways`` (id, nbr, w and more; loops among them) written in buckets, under ``path`` if they are to stay."""
    spark = ways.sparkSession
    degrees = ways.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    seen = Observation()
    # A row a hub: at most a HUB_ROWS-th of the edges.
    hubs = degrees.observe(seen, F.coalesce(F.sum("degree"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("ids"), F.count_if(F.col("degree") > HUB_ROWS).alias("hubs"))
    hubs = Table(hubs.where(F.col("degree") > HUB_ROWS))
    rows, ids, many = (seen.get[c] for c in ("rows", "ids", "hubs"))
    n, hub = bucket_count(rows, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))), HUB_ROWS
    if ids > BROADCAST_ROWS and rows > DENSE * ids:
        n = min(n, max(FEW_BUCKETS, spark.sparkContext.defaultParallelism, -(-rows // MOST_ROWS)))
        # The same share of a bucket as elsewhere.
        hub = max(hub, rows // n >> 5)
    if many:
        seen = Observation()
        cut = hubs.df.where(F.col("degree") > hub).observe(seen, F.count(F.lit(1)).alias("hubs"))
        pieces = Table(cut.select("id", F.ceil(F.col("degree") / hub).cast("int").alias("pieces")), path and f"{path}/pieces").df
        many = seen.get["hubs"]
    hubs.drop()
    path = path and f"{path}/ways"
    if not many:
        return Placed(Buckets(ways.withColumn("salt", F.lit(0)), n, "id", path=path).df, rows, None, n)
    salt = F.when(F.col("id") == F.col("nbr"), 0).otherwise(F.pmod(F.xxhash64("nbr"), F.col("pieces")).cast("int"))
    cut = ways.join(pieces, "id", "left").withColumn("salt", F.coalesce(salt, F.lit(0))).drop("pieces")
    return Placed(Buckets(cut, n, "id", "salt", path=path).df, rows, pieces, n)


def spread(adj: Placed | Cells, state: DataFrame, numeric: Numeric, label: str, moved: str, small: bool) -> DataFrame:
    """``state`` (id and more) with part and whole, the sums of w ``label`` and w over the neighbours, and nudged: whether one of them is ``moved``."""
    own, columns = F.col("id") == F.col("nbr"), [c for c in state.columns if c != "id"]
    if isinstance(adj, Cells):
        return adj.sums(state, F.col(label), F.col(moved), columns).drop("near")
    if small:
        near, to = adj.df.join(F.broadcast(state.withColumnRenamed("id", "nbr")), "nbr"), "id"
    else:
        # Every edge is there in both directions: a vertex's label goes to its bucket and from there to its neighbours.
        near, to = adj.beside(state), "nbr"
    sums = [numeric.products(F.col("w"), F.col(label)).alias("part"), F.sum("w").alias("whole"), F.max(F.when(~own, F.col(moved))).alias("nudged")]
    mine = [F.max(F.when(own, F.col(c))).alias(c) for c in columns]
    if small and adj.pieces is not None:
        pieces = near.groupBy("id", "salt").agg(*sums, *mine)
        out = pieces.groupBy("id").agg(F.sum("part").alias("part"), F.sum("whole").alias("whole"), *[F.max(c).alias(c) for c in ("nudged", *columns)])
    else:
        out = near.groupBy(F.col(to).alias("id")).agg(*sums, *mine)
    return out.where(F.col(label).isNotNull())


def sweep(adj: Placed, state: DataFrame, i: int, step, numeric: Numeric, full: bool, first: bool, small: bool) -> DataFrame:
    """``state`` (id, open, f0 .. f of i - 1, m of i - 1) after its ``i``-th sweep: with f and m (moved) of i."""
    f, m = F.col(f"f{i - 1}"), F.col(f"m{i - 1}")
    pulled = spread(adj, state, numeric, f"f{i - 1}", f"m{i - 1}", small)
    active = F.col("open") if full else F.col("open") & (m if first else m | F.coalesce("nudged", F.lit(False)))
    after = pulled.withColumn(f"f{i}", F.when(active, numeric.ratio(F.col("part"), F.col("whole"), f)).otherwise(f))
    return after.select("id", "open", *[f"f{j}" for j in range(i + 1)], (F.abs(F.col(f"f{i}") - f) > F.lit(step)).alias(f"m{i}"), *[f"m{j}" for j in range(1, i)])


def hash_of(f: str, m: str) -> Column:
    return F.xxhash64("id", F.col(f), F.col(m))


def whole_sum(h: Column) -> Column:
    return F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))


class LabelLog:
    """The state (id, open, f, moved): a base table and runs of changed rows, the newest row of an id counting."""

    def __init__(self, base: Table, df: DataFrame, rows: int):
        self.base, self.df, self.rows, self.runs, self.changed = base, df, rows, [], 0

    def newest(self) -> DataFrame | None:
        """The newest row of each id in the runs."""
        if len(self.runs) < 2:
            return self.runs[0].df if self.runs else None
        every = None
        for k, run in enumerate(self.runs):
            one = run.df.withColumn("run", F.lit(k))
            every = one if every is None else every.unionByName(one)
        last = F.max_by(F.struct("open", "f", "moved"), "run").alias("row")
        return every.groupBy("id").agg(last).select("id", "row.open", "row.f", "row.moved")

    def current(self) -> DataFrame:
        if not self.runs:
            return self.df
        over = self.newest().select("id", F.col("f").alias("new_f"), F.col("moved").alias("new_moved")).hint("merge")
        return self.df.join(over, "id", "left").select("id", "open", F.coalesce("new_f", "f").alias("f"), F.coalesce("new_moved", "moved").alias("moved"))

    def movers(self) -> DataFrame:
        """(id): all that moved lies in the last run."""
        return (self.runs[-1].df if self.runs else self.df).where("moved").select("id")

    def push(self, run: Table, rows: int) -> int:
        """Takes a run of ``rows`` rows in; returns how many rows merging wrote, if it did."""
        self.runs.append(run)
        self.changed += rows
        if len(self.runs) < MERGE and self.changed <= SPARSE * self.rows * MERGE:
            return 0
        # The last run stays: it says who moved.
        last = self.runs.pop()
        whole = self.changed > SPARSE * self.rows * MERGE
        seen = Observation()
        merged = Table((self.current() if whole or not self.runs else self.newest()).observe(seen, F.count(F.lit(1)).alias("rows")))
        for old in self.runs:
            old.drop()
        if whole:
            self.base.drop()
            self.base, self.df, self.runs, self.changed = merged, merged.df, [last], rows
        else:
            self.runs = [merged, last]
        return seen.get["rows"]

    def drop(self) -> None:
        for table in (self.base, *self.runs):
            table.drop()


def propagate_step(adj: DataFrame, labels: DataFrame, frontier: DataFrame, numeric: Numeric = DOUBLE) -> DataFrame:
    """(id, f): ``labels`` after one synchronous sweep over ``frontier`` (id)."""
    pulled = pull(adj.join(frontier.select("id"), "id", "left_semi"), labels.select("id", "f"), numeric)
    return labels.select("id", "f").join(pulled, "id", "left").select("id", numeric.ratio(F.col("part"), F.col("whole"), F.col("f")).alias("f"))


def changed_vertices(before: DataFrame, after: DataFrame, delta) -> DataFrame:
    """(id) whose label moved by more than delta."""
    old = before.select("id", F.col("f").alias("old"))
    return after.join(old, "id").where(F.abs(F.col("f") - F.col("old")) > F.lit(delta)).select("id")


def frontier_next(changed: DataFrame, adj: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id): the changed vertices and their neighbours, of those ``allowed`` to change."""
    near = adj.join(changed.select(F.col("id")), "id", "left_semi").select(F.col("nbr").alias("id"))
    return changed.select("id").union(near).distinct().join(allowed.select("id"), "id", "left_semi")


def frontier(affected: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id): affected vertices that may change."""
    return affected.select("id").distinct().join(allowed.select("id"), "id", "left_semi")


def enforce_gt(labels: DataFrame, known: DataFrame, numeric: Numeric = DOUBLE) -> DataFrame:
    """(id, f) with known vertices pinned to their class."""
    return labels.join(known.select("id", "gt_class"), "id", "left").select("id", F.coalesce(numeric.class_label(F.col("gt_class")), F.col("f")).alias("f"))


class Run:
    """A propagation on its way: the log, the sweeps made and the digests of their states."""

    def __init__(self, adj: Placed, log: LabelLog, step, numeric: Numeric, full: bool):
        self.adj, self.log, self.step, self.numeric, self.full = adj, log, step, numeric, full
        self.small, self.swept, self.movers = log.rows <= BROADCAST_ROWS and not isinstance(adj, Cells), 0, 0
        self.digests: dict[tuple, int] = {}
        self.last: tuple[int, int] = (0, 0)
        self.written: list[int] = []
        self.period: int | None = None
        #: Iterations and convergence of the components that were split off.
        self.apart: tuple[int, bool] | None = None

    def split(self, most: int) -> None:
        """Sweeps all components of at most SETTLE_ROWS rows that still move to the end, each in a task; the others go on."""
        # Tables of a row a vertex meet by shuffles: a broadcast passes the driver.
        now = self.log.current() if self.small else self.log.current().hint("merge")
        open_ = now.where("open").select("id")
        end = lambda c: open_.withColumnRenamed("id", c)
        by_cells = isinstance(self.adj, Cells)
        inner = self.adj.lines.where("free").select("src", "dst") if by_cells else self.adj.df.where("id < nbr")
        if by_cells:
            pass
        elif "free" in self.adj.df.columns:
            inner = inner.where("free").select(F.col("id").alias("src"), F.col("nbr").alias("dst"))
        else:
            inner = inner.select(F.col("id").alias("src"), F.col("nbr").alias("dst")).join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi")
        roots = connected_components(inner, open_, None if self.small else -1)
        dealt = (lambda df: df) if self.small else lambda df: df.hint("merge")
        moving = roots.join(dealt(self.log.movers()), "id", "left_semi").select("root").distinct()
        members = roots.join(dealt(moving), "root", "left_semi")
        if by_cells:
            degrees = self.adj.sums(now.select("id", "f"), F.col("f"), F.lit(False), []).select("id", "near")
            sizes = members.join(degrees.hint("merge"), "id").groupBy("root").agg(F.sum(F.col("near") + 1).alias("n"))
        else:
            rows = self.adj.df.join(members, "id") if self.small else self.adj.beside(members)
            rows = rows.select("id", "nbr", "w", "root")
            sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        seen = Observation()
        # A row a component that moves.
        small = sizes.where(F.col("n") <= SETTLE_ROWS)
        small = Table(small.observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))).df
        if not seen.get["rows"]:
            self.apart = 0, True
            return
        if by_cells:
            rows = self.adj.beside(members.join(dealt(small), "root", "left_semi").select("id", "root"))
        parts = -(-2 * seen.get["rows"] // ROWS_PER_TASK)
        near = now.select(F.col("id").alias("nbr"), "f", "open", "moved")
        rows = rows.join(dealt(small.select("root", F.pmod(F.xxhash64("root"), F.lit(parts)).alias("part"))), "root").join(near, "nbr")
        done, iterations, settled = settle_parts(rows.select("part", "id", "nbr", "w", "f", "open", "moved"), self.step, self.numeric, most, self.swept)
        ended = done.df.select("id", F.col("f").alias("end"))
        seen, still = Observation(), F.col("moved") & F.col("end").isNull()
        state = now.join(dealt(ended), "id", "left").select("id", "open", F.coalesce("end", "f").alias("f"), still.alias("moved"))
        table = Table(state.observe(seen, F.count_if("moved").alias("movers")))
        self.log.drop()
        self.log, self.movers, self.apart = LabelLog(table, table.df, self.log.rows), seen.get["movers"], (iterations, settled)
        self.digests, self.period = {}, None
        self.written.append(self.log.rows)

    def remember(self, at: int, digest: tuple[int, int]) -> None:
        if (before := self.digests.get(digest)) is not None:
            self.period = at - before
        self.digests[digest], self.last = at, digest

    def block(self, most: int) -> None:
        """Up to ``most`` sweeps of all vertices in one job, back to the one that moves nothing."""
        if isinstance(self.adj, Cells):
            # What earlier sweeps shuffled goes from the disks when the driver collects its garbage.
            self.adj.tiles.sparkSession._jvm.System.gc()
        start = self.log.current().select("id", "open", F.col("f").alias("f0"), F.col("moved").alias("m0"))
        state = start
        for i in range(1, most + 1):
            state = sweep(self.adj, state, i, self.step, self.numeric, self.full, self.swept == 0 and i == 1, self.small)
        seen, metrics = Observation(), []
        for i in range(1, most + 1):
            h = hash_of(f"f{i}", f"m{i}")
            metrics += [F.count_if(f"m{i}").alias(f"movers{i}"), F.coalesce(F.bit_xor(h), F.lit(0)).alias(f"xor{i}"), whole_sum(h).alias(f"sum{i}")]
        state = state.drop("f0").observe(seen, *metrics)
        # After the last aggregation, so that no sweep loses its tasks; in few files, which the next block reads.
        files = -(-self.log.rows // ROWS_PER_FILE) or 1
        table = Table(state.repartition(files, "id") if self.small else state)
        got = seen.get
        self.written.append(self.log.rows)
        for i in range(1, most + 1):
            self.swept, self.movers = self.swept + 1, got[f"movers{i}"]
            self.remember(self.swept, (got[f"xor{i}"], int(got[f"sum{i}"])))
            if not self.movers:
                break
        self.log.drop()
        self.log = LabelLog(table, table.df.select("id", "open", F.col(f"f{i}").alias("f"), F.col(f"m{i}").alias("moved")), self.log.rows)

    def sparse(self) -> None:
        """One sweep over the neighbourhood of the movers; writes what changes."""
        now, moving = self.log.current().hint("merge"), self.log.movers().hint("merge")
        near = self.adj.df.select("id", "nbr").join(moving, "id", "left_semi").select(F.col("nbr").alias("id")).distinct()
        near = now.join(near, "id", "left_semi")
        pulled = pull(self.adj.df.select("id", "nbr", "w").join(near.where("open").select("id").hint("merge"), "id", "left_semi"), now.select("id", "f"), self.numeric)
        f = F.when(F.col("open"), self.numeric.ratio(F.col("part"), F.col("whole"), F.col("f"))).otherwise(F.col("f"))
        after = near.join(pulled.hint("merge"), "id", "left").select("id", "open", f.alias("f"), F.col("f").alias("old"), F.col("moved").alias("was"))
        after = after.withColumn("moved", F.abs(F.col("f") - F.col("old")) > F.lit(self.step)).where((F.col("f") != F.col("old")) | (F.col("moved") != F.col("was")))
        new, old, seen = hash_of("f", "moved"), hash_of("old", "was"), Observation()
        metrics = [F.count(F.lit(1)).alias("rows"), F.count_if("moved").alias("movers"), F.coalesce(F.bit_xor(new.bitwiseXOR(old)), F.lit(0)).alias("xor"), (whole_sum(new) - whole_sum(old)).alias("sum")]
        run = Table(after.observe(seen, *metrics).select("id", "open", "f", "moved"))
        got = seen.get
        self.swept, self.movers = self.swept + 1, got["movers"]
        self.remember(self.swept, (self.last[0] ^ got["xor"], self.last[1] + int(got["sum"])))
        merged = self.log.push(run, got["rows"])
        self.written.append(got["rows"] + merged)

    def forward(self, most: int) -> None:
        """At most ``most`` sweeps in one job."""
        few = not isinstance(self.adj, Cells) and self.log.rows > ROWS_PER_FILE and not self.full and self.swept and self.movers < SPARSE * self.log.rows
        self.sparse() if few else self.block(min(most, UNROLL))


def differing(before: DataFrame, after: DataFrame) -> int:
    """Vertices whose label or motion is not the same in two states."""
    other = after.select("id", F.col("f").alias("g"), F.col("moved").alias("n"))
    return before.join(other.hint("merge"), "id").where((F.col("f") != F.col("g")) | (F.col("moved") != F.col("n"))).count()


def propagate(adj: DataFrame | Placed | Cells, labels: DataFrame, known: DataFrame, seeds: DataFrame | None, delta: float = 1e-4, max_iterations: int = MAX_SWEEPS, numeric: Numeric = DOUBLE) -> Propagated:
    """Sweeps until nothing moves by more than delta or the cap is reached.

    labels: (id, f) of the live vertices; known: (id, gt_class), which never move; seeds: the first
    frontier (id), or None for every vertex in every sweep (the full recompute). A ``Placed`` adjacency holds the loops of its vertices, ``Cells`` need none.
    """
    full, step = seeds is None, numeric.delta(delta)
    # Tables of a row a vertex meet by shuffles, however many there are.
    classes = known.select("id", "gt_class").hint("merge")
    start = enforce_gt(labels, classes, numeric).join(classes, "id", "left").withColumn("open", F.col("gt_class").isNull())
    if full:
        start = start.withColumn("moved", F.col("open"))
    else:
        start = start.join(seeds.select("id", F.lit(True).alias("on")).distinct().hint("merge"), "id", "left").withColumn("moved", F.coalesce("on", F.lit(False)) & F.col("open"))
    seen = Observation()
    state = Table(start.select("id", "open", "f", "moved").observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("moved").alias("on")))
    rows, movers = seen.get["rows"], seen.get["on"]
    if not movers or not max_iterations:
        return Propagated(state.df.select("id", "f"), 0, not movers)
    by_cells = isinstance(adj, Cells)
    if not isinstance(adj, Placed | Cells):
        adj = place(adj.select("id", "nbr", "w").unionByName(loops(state.df, adj)))
    if not by_cells and max(adj.rows, rows) <= ROWS_PER_TASK:
        out, iterations, converged, swept = settle(adj.df, state.df, step, numeric, max_iterations, full)
        state.drop()
        return Propagated(out.df, iterations, converged, swept, [rows])
    run = Run(adj if by_cells else replace(adj, df=adj.df.persist()), LabelLog(state, state.df, rows), step, numeric, full)
    run.movers, held, iterations = movers, None, None
    while run.movers and run.swept < max_iterations:
        left = max_iterations - run.swept
        if held:
            at, period, snapshot = held
            run.forward(min(left, at + period - run.swept))
            if run.movers and run.swept == at + period:
                same = not differing(snapshot.df, run.log.current())
                snapshot.drop()
                held, run.period = None, None
                if same:
                    # What follows repeats: only the place of the cap in the period matters.
                    rest, iterations = (max_iterations - run.swept) % period, max_iterations
                    until = run.swept + rest
                    while run.swept < until:
                        run.forward(until - run.swept)
                    break
        elif run.apart is None and not full and run.swept >= SPLIT:
            run.split(max_iterations)
        else:
            run.forward(left)
            if run.period and run.movers and run.swept + run.period < max_iterations:
                held = run.swept, run.period, Table(run.log.current())
            run.period = None
    if held:
        held[2].drop()
    if not by_cells:
        adj.df.unpersist()
    apart, settled = run.apart or (0, True)
    return Propagated(run.log.current().select("id", "f"), max(iterations or run.swept, apart), settled and not run.movers, run.swept, run.written)


def full_propagate_step(adj: DataFrame, labels: DataFrame, known: DataFrame, numeric: Numeric = DOUBLE) -> DataFrame:
    """(id, f) after one sweep over all vertices, known ones pinned."""
    return enforce_gt(propagate_step(adj, labels, labels.select("id"), numeric), known, numeric)


def full_propagation(adj: DataFrame | Cells, vertices: DataFrame, delta: float = 1e-4, max_iterations: int = MAX_SWEEPS, numeric: Numeric = DOUBLE) -> Propagated:
    """The full recompute over ``vertices`` (id, gt_class; all live): unknown labels start at one half."""
    known = vertices.where("gt_class is not null").select("id", "gt_class")
    start = vertices.select("id", F.coalesce(numeric.class_label(F.col("gt_class")), numeric.lit(numeric.half)).alias("f"))
    return propagate(adj, start, known, None, delta, max_iterations, numeric)
