import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.config import RunConfig, parse
from tidegraph.functions.numeric import DOUBLE, FIXED, LABEL, WEIGHT
from tidegraph.operators import components as C, propagate as R, sparsify as P, state as S
from tidegraph.operators.settle import arranged, iterate
from tidegraph import queries as Q
from tidegraph.plans.engine import Engine
from tidegraph.plans.evaluate import recompute
from tidegraph.schemas import EDGES, VERTICES, Graph, check, violations
from tidegraph.sources import batches as B, generate as G, text as K

GOLD_V = [(0, 0, 0, None, 0), (1, 1, 0, None, 1), (2, 1, 1, None, None), (3, 1, 1, 2, None), (4, 0, 1, None, None), (5, 1, 1, None, 1), (6, 1, 2, None, None), (7, 0, 2, 2, None)]
GOLD_E = [(0, 2, 0.2), (1, 2, 0.8), (2, 3, 0.9), (3, 4, 0.3), (4, 5, 0.7), (0, 4, 0.4), (4, 6, 0.9), (6, 7, 0.8), (3, 6, 0.6), (1, 7, 0.5)]


def graph(spark, v, e):
    order = [(i, t, b, d, g) for i, t, b, d, g in v]
    return Graph(spark.createDataFrame(order, VERTICES), spark.createDataFrame(e, EDGES))


@pytest.fixture(scope="module")
def gold(spark):
    return graph(spark, GOLD_V, GOLD_E)


def labels(df):
    return {r.id: round(r.f, 6) for r in df.collect()}


def test_golden_batches(gold):
    engine = Engine(gold, delta=1e-4, tau=0.5)
    assert labels(engine.process_batch(0)) == {0: 0.0, 1: 1.0}
    got = labels(engine.process_batch(1))
    assert got == {0: 0.0, 1: 1.0, 2: 0.774275, 3: 0.745732, 4: 0.659791, 5: 1.0}
    got = labels(engine.process_batch(2))
    assert got == {0: 0.0, 1: 1.0, 2: 0.8, 3: 0.745732, 4: 0.636372, 5: 1.0, 6: 0.636317, 7: 0.5}
    assert [(m[0], round(m[2], 6), m[3], m[4], m[5]) for m in engine.metrics] == [(0, 1.0, 0, True, 2), (1, 0.666667, 14, True, 2), (2, 0.666667, 20, True, 1)]
    assert labels(engine.all_labels()) == got


def test_state_of_the_golden_graph(gold):
    lines = S.timeline(gold)
    ids = lambda df: sorted(r.id for r in df.collect())
    pairs = lambda df: sorted((r.src, r.dst) for r in df.collect())
    assert pairs(P.strong_new_edges(lines, gold.vertices, 1, 0.5)) == [(2, 3), (4, 5)]
    assert ids(P.insertion_affected(lines, gold.vertices, 1, 0.5)) == [2, 3, 4]
    assert ids(S.deletion_affected(lines, gold.vertices, 2)) == [2, 4, 6]
    assert pairs(S.active_edges(lines, 2)) == [(0, 2), (0, 4), (1, 2), (4, 5), (4, 6)]
    status = {r.id: r.status for r in S.vertex_status(S.change_log(gold.vertices), 2).collect()}
    assert status[7] == status[3] == "DELETED" and status[5] == "GROUND_TRUTH" and status[6] == "ACTIVE"
    assert {r.rule: r.n for r in violations(gold).collect() if r.n} == {}
    # Strictly over tau: with 7 alive, its edge of weight tau is no strong one.
    alive = Graph(gold.vertices.withColumn("delete_batch", F.when(F.col("id") == 3, 2)), gold.edges)
    assert ids(P.insertion_affected(S.timeline(alive), alive.vertices, 2, 0.8)) == [4, 6]


def plain_engine(v, e, tau, delta, sweeps, batches):
    """The canonical semantics, vertex by vertex."""
    arr, gone, gt = ({i: x[k] for i, *x in v} for k in (1, 2, 3))
    f = {}
    for b in range(batches):
        live = {i for i in arr if arr[i] <= b and (gone[i] is None or gone[i] > b)}
        act = [(s, d, w) for s, d, w in e if s in live and d in live]
        nb = {i: [] for i in live}
        for s, d, w in act:
            nb[s].append((d, w))
            nb[d].append((s, w))
        new = {i for i in live if arr[i] == b}
        root = {i: i for i in new}
        for _ in new:
            for s, d, w in act:
                if s in new and d in new and w > tau:
                    root[s] = root[d] = min(root[s], root[d])
        for i in arr:
            if arr[i] == b:
                f[i] = 0.5
        for r in set(root.values()):
            w0, w1 = (sum(w for i in new if root[i] == r for j, w in nb[i] if gt[j] == k) for k in (0, 1))
            for i in new:
                if root[i] == r:
                    f[i] = float(gt[i]) if gt[i] is not None else w1 / (w0 + w1) if w0 + w1 > 1e-10 else 0.5
        hot = {i for s, d, w in act if max(arr[s], arr[d]) == b and w > tau for i in (s, d)}
        hot |= {i for s, d, w in e if max(arr[s], arr[d]) <= b and b in (gone[s], gone[d]) and all(gone[x] is None or gone[x] >= b for x in (s, d)) for i in (s, d)}
        hot = {i for i in hot if i in live and gt[i] is None}
        for _ in range(sweeps):
            if not hot:
                break
            after = dict(f)
            for i in hot:
                total = sum(w for _, w in nb[i])
                if total > 1e-10:
                    after[i] = sum(w * f[j] for j, w in nb[i]) / total
            moved = {i for i in hot if abs(after[i] - f[i]) > delta}
            hot = {j for i in moved for j in [i, *(x for x, _ in nb[i])] if gt[j] is None}
            f = after
    return f


def random_graph(seed, n=60, m=110):
    rng = random.Random(seed)
    v = []
    for i in range(n):
        known = i < 6 or rng.random() < 0.05
        batch = 0 if i < 6 else rng.randint(1, 2)
        y = i % 2
        v.append((i, y, batch, None if known or rng.random() < 0.8 else rng.randint(batch, 2), y if known else None))
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return v, [(a, b, round(rng.uniform(0.05, 1), 3)) for a, b in sorted(pairs)]


def test_unsound_graphs_are_refused(spark, gold):
    """Nulls, loops, repeats, missing ends and impossible lives are counted, and the engine refuses them when asked to look."""
    v = [*GOLD_V, (7, 0, 2, 2, None), (8, 1, 3, 1, None), (9, 0, 1, 2, 0)]
    e = [*GOLD_E, (0, 2, 0.5), (5, 5, 0.5), (7, 6, 0.5), (8, 40, 0.0), (8, 9, None), (None, 1, 0.5)]
    bad = graph(spark, v, e)
    want = {"self_loop_or_order": 3, "repeated_edge": 1, "weight_not_positive": 2, "repeated_vertex": 1, "known_vertex_deleted": 1, "deleted_before_arrival": 1, "unknown_endpoint": 2}
    assert {r.rule: r.n for r in violations(bad).collect()} == want
    with pytest.raises(ValueError, match="unknown_endpoint"):
        Engine(bad, check=True)
    empty = graph(spark, [], [])
    assert check(gold) is gold and check(empty) is empty


def test_engine_is_the_plain_one(spark):
    v, e = random_graph(3)
    engine = Engine(graph(spark, v, e), delta=1e-3, tau=0.45, max_iterations=5)
    want = plain_engine(v, e, 0.45, 1e-3, 5, 3)
    got = {r.id: r.f for r in engine.run(3).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5000 + i) for i in range(150)] + [(7, 7)]
    root = {i: i for e in edges for i in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.root for r in C.connected_components(df, spark.createDataFrame([(9999,)], "id long")).collect()}
    assert got == {i: find(i) for i in root} | {9999: 9999}
    assert C.connected_components(df.limit(0)).count() == 0


def test_components_are_maintained_over_batches(spark):
    v, e = random_graph(11, n=80, m=90)
    engine = Engine(graph(spark, v, e), tau=0.4)
    for b in range(3):
        got = {r.id: r.root for r in engine.regions_of(b).collect()}
        alive = engine.vertices.where(S.live(b)).select("id")
        assert got == {r.id: r.root for r in C.connected_components(S.active_edges(engine.lines, b), alive).collect()}
    assert len(set(got.values())) < len(got)
    # A batch that was not the next one is made anew; one without changes is passed on.
    engine.regions = (0, engine.regions[1])
    assert {r.id: r.root for r in engine.regions_of(2).collect()} == got
    none = engine.lines.limit(0)
    assert {r.id: r.root for r in C.maintained_components(engine.regions[1], S.active_edges(engine.lines, 2), none, none, alive).collect()} == got


def test_sweep_cases(spark):
    adj = S.adjacency(spark.createDataFrame([(0, 1, 1.0), (2, 3, 0.0)], EDGES))
    start = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 0.3), (3, 0.9), (4, 0.4)], "id long, f double")
    none = spark.createDataFrame([], "id long, gt_class int")
    out = R.propagate(adj, start, none, start.select("id"), 1e-4, 5)
    assert not out.converged and out.iterations == 5  # a pair without a known class swings
    assert labels(out.labels) == {0: 1.0, 1: 0.0, 2: 0.3, 3: 0.9, 4: 0.4}
    assert R.propagate(adj, start, none, start.select("id"), 1e-4, 0).iterations == 0
    done = R.propagate(adj, start, none, start.select("id").limit(0))
    assert done.converged and done.iterations == 0
    known = start.select("id", F.lit(1).alias("gt_class"))
    assert R.propagate(adj, start, known, start.select("id")).iterations == 0


def test_hubs_do_not_overflow_fixed_point(spark):
    n = 60_000
    e = spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(WEIGHT).cast("long").alias("w"))
    start = spark.range(n).select("id", F.when(F.col("id") == 0, 0).otherwise(LABEL).cast("long").alias("f"))
    got = R.propagate_step(S.adjacency(e), start, start.select("id").where("id = 0"), FIXED).where("id = 0").first()
    assert got.f == LABEL


def test_incremental_is_near_the_recompute(spark):
    v, e = random_graph(8)
    v = [(i, y, b, None, g) for i, y, b, _, g in v]
    g = graph(spark, v, e)
    lab = {r.id: r.f for r in Engine(g, delta=1e-2, tau=0.3, seed_mode="all", max_iterations=12, freeze_gt_free=True).run(3).collect()}
    full, _ = recompute(g, 2, 1e-2, 12)
    roots = {r.id: r.root for r in C.connected_components(g.edges, g.vertices.select("id")).collect()}
    with_known = {roots[i] for i, *_, k in v if k is not None}
    assert max(abs(lab[r.id] - r.f) for r in full.labels.collect() if roots[r.id] in with_known) < 0.15


def test_generators(spark, tmp_path):
    n, deg = 400, 5
    lab, edges = G.gen_graph(spark, n, deg, 42)
    assert edges.count() == n * deg // 2 and lab.where("true_label = 0").count() == n // 2
    g = B.gen_batches(lab, edges, RunConfig(total_nodes=n, num_batches=4))
    assert {r.rule: r.n for r in violations(g).collect() if r.n} == {}
    assert C.connected_components(edges).select("root").distinct().count() == 1
    y = {r.id: r.true_label for r in lab.collect()}
    assert all((0.5 <= r.w < 1) if y[r.src] == y[r.dst] else (0.01 <= r.w < 0.5) for r in edges.collect())
    again = G.gen_graph(spark.newSession(), n, deg, 42)[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, edges.collect()))
    counts = {r.batch_id: r for r in B.batch_summary(g).collect()}
    assert (counts[0].inserted, counts[0].known) == (4, 4) and [counts[b].inserted for b in (1, 2, 3)] == [132, 132, 132]
    assert all(counts[b].known == 1 and counts[b].deleted == 11 for b in (1, 2, 3))
    path = str(tmp_path / "out")
    K.write_graph(edges, lab, path)
    back, lab2 = K.read_graph(spark, path)
    flat = lambda df: sorted((r.src, r.dst, round(r.w, 6)) for r in df.collect())
    assert flat(back) == flat(edges) and sorted(map(tuple, lab2.collect())) == sorted(map(tuple, lab.collect()))
    K.write_labels(lab.select("id", (F.col("true_label") / 3).alias("f")), f"{path}/labels")
    first = spark.read.text(f"{path}/labels").orderBy(F.split("value", " ")[0].cast("long")).first().value
    assert first == f"0 {y[0] / 3:.6f}"
    K.write_metrics(spark.createDataFrame([(1, 2.345, 0.5), (0, 1.0, 1.0)], "batch_id int, time_ms double, accuracy double"), f"{path}/results")
    assert [r.value for r in spark.read.text(f"{path}/results").collect()] == ["batch,time_ms,accuracy", "0,1.00,1.000000", "1,2.35,0.500000"]


def test_dense_graphs_get_every_edge_they_ask_for(spark):
    for n, degree, want in ((40, 39, 780), (40, 50, 780), (30, 20, 300), (2, 1, 1), (12, 1, 11)):
        edges = [(r.src, r.dst) for r in G.gen_edges(spark, n, degree).collect()]
        assert len(set(edges)) == len(edges) == want and all(0 <= a < b < n for a, b in edges)


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_deletions_are_those_of_a_queue(spark, monkeypatch, block):
    """Each batch takes the first of all who live; blocks of seven deal the same."""
    monkeypatch.setattr(B, "DELETION_BLOCK", block)
    rng = random.Random(block)
    v = [(i, 0, rng.choice([0, 1, 1, 2, 3, 3, None]), None, 1 if rng.random() < 0.2 else None) for i in range(300)]
    for fraction in (0.3, 0.9, 0.0):
        got = {r.id: r.delete_batch for r in B.deletions(spark.createDataFrame(v, VERTICES), fraction, 4, [F.col("id") * 37 % 101, F.col("id")]).collect()}
        want = {}
        for b in range(1, 4):
            pool = sorted((i * 37 % 101, i) for i, _, a, _, k in v if a is not None and a <= b and k is None and i not in want)
            want |= {i: b for _, i in pool[: int(sum(a == b for _, _, a, _, _ in v) * fraction)]}
        assert got == want


def test_mean_weights_and_labels_over_time(spark, monkeypatch):
    from tidegraph.plans import evaluate as E

    v, e = random_graph(4)
    g = graph(spark, v, e)
    lines = S.timeline(g)
    taus = {r.batch_id: (r.edges, r.tau) for r in S.batch_taus(lines, 4).collect()}
    for b in range(4):
        active = S.active_edges(lines, b)
        assert taus[b][0] == active.count() and abs(taus[b][1] - S.auto_tau(active)) < 1e-12
    assert [r.tau for r in S.batch_taus(lines.limit(0), 2).collect()] == [0.5, 0.5]
    engine = Engine(g, delta=1e-3, tau=0.45, max_iterations=5, keep=True)
    told = [labels(engine.process_batch(b)) for b in range(3)]
    history = engine.history().collect()
    for b in range(3):
        assert {r.id: round(r.f, 6) for r in history if r.starts <= b and (r.ends is None or r.ends > b)} == told[b]
    got = {r.batch_id: r.accuracy for r in E.accuracy_by_batch(engine.history(), engine.vertices, 3).collect()}
    assert got == {m[0]: m[2] for m in engine.metrics}
    active = Engine(g, tau_scope="active")
    assert abs(active.batch_tau(1) - taus[1][1]) < 1e-12 and len(active.taus) == 16 and abs(active.batch_tau(20) - taus[3][1]) < 1e-9


def test_config():
    c = parse(["--totalNodes", "10", "--gtFraction", "0.005", "--noValidate", "--quiet"])
    assert (c.total_nodes, c.ground_truth_fraction, c.validate, c.verbose) == (10, 0.005, False, False)
    for bad in (["--nope"], ["--delta"], ["--delta", "0"], ["--gtFraction", "0.5"], ["--numBatches", "0"]):
        with pytest.raises(SystemExit):
            parse(bad)
    assert DOUBLE.one == 1.0 and FIXED.delta(1e-4) == 10_000


def test_streaming_feed(spark, tmp_path, gold):
    from tidegraph.streaming import feed

    log = S.change_log(gold.vertices).join(gold.vertices.select("id", "true_label"), "id").select("batch_id", "id", "op", "gt_label", "true_label")
    incoming, state = str(tmp_path / "in"), str(tmp_path / "state")
    for b in range(3):
        log.where(F.col("batch_id") == b).coalesce(1).write.mode("append").parquet(incoming)
    feed.follow(spark, incoming, gold.edges, state, delta=1e-4, tau=0.5).awaitTermination()
    assert labels(spark.read.parquet(f"{state}/batch=2"))[4] == 0.636372
    feed.process(spark, log.limit(0), gold.edges, state, 2)  # a replayed batch changes nothing
    assert labels(spark.read.parquet(f"{state}/batch=2"))[4] == 0.636372


def test_streaming_takes_files_gaps_and_late_batches(spark, tmp_path, gold):
    from tidegraph.streaming import feed

    log = S.change_log(gold.vertices).join(gold.vertices.select("id", "true_label"), "id").select("batch_id", "id", "op", "gt_label", "true_label")
    incoming, state, ran = str(tmp_path / "in"), str(tmp_path / "state"), []
    pieces = ["batch_id = 0 and id = 0", "batch_id = 0 and id = 1", "batch_id = 2", "batch_id = 1 and id < 4", "batch_id = 1 and id >= 4"]
    for piece in pieces:
        log.where(piece).coalesce(1).write.mode("append").parquet(incoming)
    apply = feed.apply
    feed.apply = lambda *a, **k: ran.append(apply(*a, **k))
    try:
        feed.follow(spark, incoming, gold.edges, state, delta=1e-4, tau=0.5).awaitTermination()
    finally:
        feed.apply = apply
    assert ran == [[0], [0], [2], [1, 2], [1, 2]]  # two files of a batch, a gap, and the late batch in two files
    engine = Engine(gold, delta=1e-4, tau=0.5)
    for b in range(3):
        assert labels(engine.process_batch(b)) == labels(spark.read.parquet(f"{state}/batch={b}"))
    assert apply(spark, log.where(pieces[2]), gold.edges, state, "epoch-2") == []  # replayed


def plain_sweeps(edges, start, known, delta, cap):
    """Labels, sweeps and whether nothing moves any more, of the plain iteration."""
    nb = {i: [] for i in start}
    for a, b, w in edges:
        nb[a].append((b, w))
        nb[b].append((a, w))
    f = {i: float(known.get(i, x)) for i, x in start.items()}
    hot, done = set(start) - known.keys(), 0
    while hot and done < cap:
        after = f | {i: min(1.0, max(0.0, sum(w * f[j] for j, w in nb[i]) / sum(w for _, w in nb[i]))) for i in hot if sum(w for _, w in nb[i]) > 1e-10}
        moved = {i for i in hot if abs(after[i] - f[i]) > delta}
        hot = {j for i in moved for j in [i, *(x for x, _ in nb[i])]} - known.keys()
        f, done = after, done + 1
    return f, done, not hot


def swept(spark, edges, start, known, delta, cap):
    adj = S.adjacency(spark.createDataFrame(edges, EDGES))
    labels_ = spark.createDataFrame(list(start.items()), "id long, f double")
    return R.propagate(adj, labels_, spark.createDataFrame(list(known.items()), "id long, gt_class int"), labels_.select("id"), delta, cap)


def test_streaming_edges_come_early_and_late(spark, tmp_path, gold):
    """Vertices and edges in files of their own: edges wait for their ends, come after them, and come again."""
    from tidegraph.streaming import feed

    log = S.change_log(gold.vertices).join(gold.vertices.select("id", "true_label"), "id")
    when = {(0, 2): 0, (4, 6): 1, (1, 7): 2, (3, 4): 2, (4, 5): 2}  # others are known from the start
    came = [(b, "edge", s, d, w) for (s, d, w) in GOLD_E if (b := when.get((s, d))) is not None]
    came[0] = (came[0][0], "edge", came[0][3], came[0][2], came[0][4])  # the other way round
    from_start = spark.createDataFrame([e for e in GOLD_E if (e[0], e[1]) not in when], EDGES)
    rows = feed.in_form(log).unionByName(feed.in_form(spark.createDataFrame(came, "batch_id int, op string, src long, dst long, w double")))
    again = feed.in_form(spark.createDataFrame([(2, "edge", 4, 4, 1.0), (2, "edge", 4, 5, 0.7)], "batch_id int, op string, src long, dst long, w double"))
    state = str(tmp_path / "state")
    for k, piece in enumerate([rows.where("batch_id = 0 and op = 'edge'"), rows.where("batch_id = 0 and op != 'edge'"), rows.where("batch_id = 2 and op = 'edge'").unionByName(again), rows.where("batch_id = 1"), rows.where("batch_id = 2 and op != 'edge'")]):
        feed.apply(spark, piece, from_start, state, f"p{k}", delta=1e-4, tau=0.5)
    since = F.create_map(*[F.lit(x) for (a, b), n in when.items() for x in (a * 10 + b, n)])[F.col("src") * 10 + F.col("dst")]
    engine = Engine(Graph(gold.vertices, gold.edges.withColumn("since", since)), delta=1e-4, tau=0.5)
    for b in range(3):
        assert labels(engine.process_batch(b)) == labels(spark.read.parquet(f"{state}/batch={b}"))
    assert feed.Kept.at(spark, state).current("pending").count() == 0
    assert feed.apply(spark, rows.where("batch_id = 1"), from_start, state, "p3") == []


def test_small_pieces_write_few_rows(spark, tmp_path):
    """100 changes on a million edges; and the kept ways are those of a graph made at once, also after runs were merged."""
    from tidegraph.streaming import feed, kept

    n, m, state = 100_000, 1_000_000, str(tmp_path / "state")
    edges = spark.range(m).select((F.col("id") % n).alias("src"), ((F.col("id") % n + 1 + F.floor(F.col("id") / n) * 7) % n).alias("dst"), F.lit(0.5).alias("w"))
    edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").distinct()
    every = feed.in_form(spark.range(n).select(F.lit(0).alias("batch_id"), "id", F.lit("insert").alias("op"), F.lit(None).cast("int").alias("gt_label"), F.lit(1).alias("true_label")))
    store, _ = kept.taken_in(spark, state, "first", every, edges)
    store.commit()
    base = store.manifest["tables"]["ways"][0][1]
    for k in range(2):
        gone = feed.in_form(spark.range(100).select(F.lit(k + 1).alias("batch_id"), (F.col("id") * 991 + k).alias("id"), F.lit("delete").alias("op")))
        store, first = kept.taken_in(spark, state, f"next{k}", gone, edges)
        assert first == k + 1 and not store.merge(f"next{k}")
        store.commit()
        (_, rows) = store.manifest["tables"]["ways"][-1]
        assert 1000 < rows < 0.05 * base
    changes = spark.read.parquet(f"{state}/kept/spans/next0", f"{state}/kept/spans/next1").select("id", F.col("delete_batch").alias("d"))
    v = spark.range(n).join(changes, "id", "left").select("id", F.lit(1).alias("true_label"), F.lit(0).alias("batch_id"), F.col("d").alias("delete_batch"), F.lit(None).cast("int").alias("gt_class"))
    want = S.timeline(Graph(v, edges))
    got = store.current("ways").where("id < nbr").select(F.col("id").alias("src"), F.col("nbr").alias("dst"), "w", "starts", "ends")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    store.settle("ways", store.current("ways"), "merged", base)
    got = store.current("ways").where("id < nbr").select(F.col("id").alias("src"), F.col("nbr").alias("dst"), "w", "starts", "ends")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("share", [R.ROWS_PER_TASK, 0])
def test_swings_end_with_the_labels_of_the_cap(spark, monkeypatch, share):
    monkeypatch.setattr(R, "ROWS_PER_TASK", share or 1)
    monkeypatch.setattr(R, "SETTLE_ROWS", share or 1)
    monkeypatch.setattr(R, "bucket_count", lambda rows, most: 2)
    edges, start, known = [(0, 1, 1.0), (2, 3, 0.4), (3, 4, 0.6)], {0: 0.0, 1: 1.0, 2: 0.0, 3: 0.9, 4: 0.4}, {2: 0}
    for cap in (10_000, 10_001):
        out = swept(spark, edges, start, known, 1e-4, cap)
        want, done, settled = plain_sweeps(edges, start, known, 1e-4, cap)
        got = {r.id: r.f for r in out.labels.collect()}
        assert (out.iterations, out.converged) == (done, settled) == (cap, False) and out.swept < 200
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want) and got[0] == want[0]


@pytest.mark.parametrize("r", [1e-4, 2e-4])
def test_slow_swings_that_die_are_followed_to_their_end(spark, r):
    """Two vertices swing; each is tied a little to a known one, so that the swing dies over tens of thousands of sweeps."""
    edges, start, known = [(0, 1, 1.0), (0, 2, r), (1, 3, r)], {0: 0.0, 1: 1.0, 2: 0.0, 3: 1.0}, {2: 0, 3: 1}
    want, done, settled = plain_sweeps(edges, start, known, 1e-4, 100_000)
    assert settled and 40_000 < done
    out = swept(spark, edges, start, known, 1e-4, 100_000)
    assert (out.iterations, out.converged, out.swept) == (done, True, done)
    assert all(abs(x.f - want[x.id]) < 1e-9 for x in out.labels.collect())


def test_small_components_are_swept_on_their_own(spark, monkeypatch):
    """A graph over several tasks: slow and lasting swings in small components, and one component larger than a task's share."""
    monkeypatch.setattr(R, "ROWS_PER_TASK", 20)
    monkeypatch.setattr(R, "SETTLE_ROWS", 20)
    monkeypatch.setattr(R, "bucket_count", lambda rows, most: 3)
    monkeypatch.setattr(R, "SPLIT", 8)
    monkeypatch.setattr(R, "SPARSE", 2.0)
    rng = random.Random(6)
    edges = [(0, 1, 1.0), (0, 50, 0.01), (1, 51, 0.01), (2, 3, 1.0), (4, 5, 0.5), (5, 6, 0.7), (6, 7, 0.2), (7, 52, 0.3)]
    edges += [(100 + i, 101 + i, round(rng.uniform(0.2, 1), 2)) for i in range(11)] + [(100, 50, 0.4), (111, 51, 0.4)]
    start = {i: rng.random() for i in [*range(8), *range(50, 53), *range(100, 112)]}
    known = {50: 0, 51: 1, 52: 1}
    out = swept(spark, edges, start, known, 1e-2, 2_001)
    want, done, settled = plain_sweeps(edges, start, known, 1e-2, 2_001)
    assert (out.iterations, out.converged) == (done, settled) and out.swept < 200
    assert all(abs(x.f - want[x.id]) < 1e-9 for x in out.labels.collect())


@pytest.mark.parametrize("fixed", [False, True])
def test_few_movers_are_swept_as_all(monkeypatch, fixed):
    """Sweeps of a task over the movers' neighbourhood give the bits of sweeps over every row."""
    rng, n = np.random.default_rng(4), 400
    pairs = np.unique(np.sort(rng.integers(0, n, (900, 2)), axis=1), axis=0)
    a, b = pairs[pairs[:, 0] < pairs[:, 1]].T
    w = rng.integers(1, 1_000_000, len(a)) if fixed else rng.random(len(a))
    open_, moved = rng.random(n) > 0.1, np.zeros(n, bool)
    moved[:5] = open_[:5]
    f = rng.integers(0, LABEL + 1, n) if fixed else rng.random(n)
    graph = arranged(np.arange(n), np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((w, w)), open_, fixed)
    runs = []
    for few in (0, 1e9):
        monkeypatch.setattr("tidegraph.operators.settle.FEW", few)
        runs.append(iterate(graph, f, moved, 100 if fixed else 1e-6, 5_000, False))
    assert (runs[0][0] == runs[1][0]).all() and runs[0][1:] == runs[1][1:] and runs[0][2] and runs[0][1] > 20


def test_distributed_sweeps_follow_swings_that_die(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_TASK", 1)
    monkeypatch.setattr(R, "SETTLE_ROWS", 1)
    monkeypatch.setattr(R, "bucket_count", lambda rows, most: 2)
    r, delta = 0.02, 0.5
    edges, start, known = [(0, 1, 1.0), (0, 2, r), (1, 3, r)], {0: 0.0, 1: 1.0, 2: 0.0, 3: 1.0}, {2: 0, 3: 1}
    want, done, settled = plain_sweeps(edges, start, known, delta, 1000)
    out = swept(spark, edges, start, known, delta, 1000)
    assert settled and done > 10 and (out.iterations, out.converged, out.swept) == (done, True, done)
    assert all(abs(x.f - want[x.id]) < 1e-9 for x in out.labels.collect())


def test_large_graphs_sweep_as_small_ones(spark, monkeypatch):
    v, e = random_graph(5)
    run = lambda: {r.id: r.f for r in Engine(graph(spark, v, e), delta=1e-3, tau=0.45, max_iterations=6).run(3).collect()}
    want = run()
    monkeypatch.setattr(R, "ROWS_PER_TASK", 1)
    monkeypatch.setattr(R, "bucket_count", lambda rows, most: 3)
    same = lambda got: got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9
    monkeypatch.setattr(R, "HUB_ROWS", 4)
    assert same(run())  # hubs in pieces, labels by broadcast
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    assert same(run())  # and by shuffle
    monkeypatch.setattr(R, "SPARSE", 1.1)
    monkeypatch.setattr(R, "ROWS_PER_FILE", 1)
    monkeypatch.setattr(R, "MERGE", 3)
    assert same(run())  # by runs of a log, which are merged
    monkeypatch.setattr(R, "HUB_ROWS", 1 << 11)
    assert same(run())


def test_few_movers_write_few_rows(spark, monkeypatch):
    """A path of 20,000 vertices, of which one end moves; the log's rows follow the movers."""
    n = 20_000
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    start = spark.range(n).select("id", F.when(F.col("id") < 100, (F.col("id") * 37 % 101) / 101).otherwise(0.5).alias("f"))
    none = spark.createDataFrame([], "id long, gt_class int")
    go = lambda: R.propagate(S.adjacency(edges), start, none, start.where("id < 100").select("id"), 1e-3, 16)
    want = go()
    monkeypatch.setattr(R, "ROWS_PER_TASK", 1 << 12)
    monkeypatch.setattr(R, "ROWS_PER_FILE", 1000)
    got = go()
    assert got.iterations == want.iterations and labels(got.labels) == labels(want.labels)
    assert got.written[0] == n and len(got.written) == 13 and max(got.written[1:]) < 0.05 * n


def test_a_hub_is_no_hot_task(spark):
    """A vertex with half of all edges; 30 buckets and more for two million directed edges, each a task of a sweep."""
    n, m = 2_000, 500_000
    ids = spark.range(m)
    far = ids.select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    near = ids.select((F.col("id") % n).alias("src"), (F.col("id") + n).alias("dst"), F.lit(1.0).alias("w"))
    adj = S.adjacency(far.unionByName(near))
    everyone = adj.select("id").distinct()
    placed = R.place(adj.unionByName(R.loops(everyone, adj)))
    assert placed.pieces.count() == 1
    kept = placed.df.persist()  # as sweeps read it: a task a bucket
    sizes = sorted(r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) >= 30 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    assert sum(sizes) == 4 * m + everyone.count()
    state = everyone.select("id", F.lit(True).alias("open"), (F.col("id") % 2).cast("double").alias("f0"), F.lit(True).alias("m0"))
    pulled = R.spread(placed, state, DOUBLE, "f0", "m0", True)
    hub = pulled.where("id = -1").first()
    assert abs(hub.part - m / 2) < 1e-6 and hub.whole == m
    plan = pulled._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryTableScan")[0].count("hashpartitioning") == 1  # of rows a piece, not of edges
    kept.unpersist()


def test_bucket_numbers_are_bounded():
    assert R.bucket_count(0, 100_000) == 1 and R.bucket_count(2_000_000, 100_000) == 31
    assert R.bucket_count(2 * 10**11, 100_000) == 100_000


def test_sweeps_have_the_tasks_of_the_adjacency(spark):
    n = 2_000
    edges = spark.range(1_000_000).select((F.col("id") % n).alias("src"), ((F.col("id") % n + 1 + F.floor(F.col("id") / n)) % n).alias("dst"), F.lit(1.0).alias("w"))
    adj = S.adjacency(edges)
    vertices = spark.range(n).select("id")
    placed = R.place(adj.unionByName(R.loops(vertices, adj)))
    state = vertices.select("id", F.lit(True).alias("open"), F.lit(0.5).alias("f0"), F.lit(True).alias("m0"))
    for i in (1, 2, 3):
        state = R.sweep(placed, state, i, 1e-4, DOUBLE, False, i == 1, True)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SelectedBucketsCount: 31 out of 31" in plan


def test_components_keep_a_row_a_vertex_of_a_task(monkeypatch):
    """Edges are joined where they lie, before any shuffle; in pieces of few vertices too, and with ends that are missing."""
    import pyarrow as pa

    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(3_000)] + [(100, None), (None, 101), (None, None), (102, 102)]
    batches = lambda rows: (pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 100]], pa.int64()) for k in (0, 1)], names=["src", "dst"]) for i in range(0, len(rows), 100))
    out = [r for b in C._forest(batches(pairs)) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert len(out) == 63 and {r for r in out if r[0] >= 100} == {(x, x) for x in (100, 101, 102)}
    monkeypatch.setattr(C, "AT_ONCE", 20)
    cut = [r for b in C._forest(batches([(i, i + 1) for i in range(1_000)])) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert len(cut) > 1_001 and set(next(C._joined(batches(cut))).column(1).to_pylist()) == {0}


def test_labels_of_many_vertices_do_not_pass_the_driver(spark, monkeypatch):
    """A dense graph: sums and labels are all that is shuffled, nothing is broadcast, and buckets are few."""
    n = 5_000
    edges = spark.range(n * 40).select((F.col("id") % n).alias("src"), ((F.col("id") % n + 1 + F.floor(F.col("id") / n)) % n).alias("dst"), F.lit(3).cast("long").alias("w"))
    adj, vertices = S.adjacency(edges), spark.range(n).select("id")
    start = vertices.select("id", (F.col("id") * 7919 % 100_000_000).alias("f"))
    none = spark.createDataFrame([], "id long, gt_class int")
    monkeypatch.setattr(R, "SETTLE_ROWS", 1)
    go = lambda: labels(R.propagate(adj, start, none, vertices, 1e-6, 5, FIXED).labels)
    got = go()
    monkeypatch.setattr(R, "ROWS_PER_TASK", 1 << 12)
    placed = R.place(adj.unionByName(R.loops(vertices, adj)))
    assert placed.buckets == max(R.FEW_BUCKETS, spark.sparkContext.defaultParallelism)
    state = start.select("id", F.lit(True).alias("open"), F.col("f").alias("f0"), F.lit(True).alias("m0"))
    for i in (1, 2):
        state = R.sweep(placed, state, i, 1, FIXED, False, i == 1, n <= R.BROADCAST_ROWS)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("hashpartitioning") == 4
    monkeypatch.setattr(R, "BROADCAST_ROWS", n)
    assert got == go()


def test_adjacency_of_the_engine_is_not_shuffled(spark, gold):
    engine = Engine(gold, delta=1e-4, tau=0.5)
    state = spark.createDataFrame([(0, True, 0.0, True)], "id long, open boolean, f0 double, m0 boolean")
    plan = R.sweep(engine.ways.where(S.active(1)), state, 1, 1e-4, DOUBLE, False, True, True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_settled_queries_run_to_the_stop_rule(spark, monkeypatch):
    v, e = random_graph(3, n=24, m=60)
    fixed = Graph(spark.createDataFrame(v, VERTICES), spark.createDataFrame([(a, b, round(w * 1_000_000)) for a, b, w in e], "src long, dst long, w long"))
    monkeypatch.setattr(Q.X, "similarity_graph", lambda s, d: fixed)
    engine = Q.settled_engine(spark, "")
    want = plain_engine(v, e, Q.TAU / 1e6, Q.DELTA, 200, Q.X.BATCHES)
    got = {r.id: r.f / 1e8 for r in engine.all_labels().collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-5
    assert all(m[4] for m in engine.metrics) and max(m[3] for m in engine.metrics) > Q.SWEEPS
    case = Q.Case(spark, "", 2, lambda s, d: fixed)
    assert Q.settled_accuracy(case).first()["converged"] and Q.converged(case).first()["converged"]
