"""Every vector goes to few blocks, whose products are made in strips."""

import pytest

from tidegraph import queries as Q
from tidegraph.functions.numeric import FIXED
from tidegraph.operators import components as C, propagate as R, sparsify as P, state as S
from tidegraph.plans import engine as N
from tidegraph.plans.evaluate import recompute
from tidegraph.schemas import Graph
from tidegraph.sources import fixtures as X

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n, most", [(1, 1), (2_000, 2), (10_000, 12), (100_000, 12), (600_000, 19)])
def test_vectors_go_to_few_blocks(n, most):
    assert X.blocks_of(n) <= most


def test_strips_make_the_pairs_of_one_product(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, X.similarity_edges(spark, SF).collect()))
    monkeypatch.setattr(X, "BLOCK", 1 << 20)
    want = rows()
    monkeypatch.setattr(X, "BLOCK", 100)
    assert len(want) > 100 and rows() == want


def test_lines_are_those_that_joins_make(spark):
    g = X.similarity_graph(spark, SF)
    joined = S.timeline(Graph(g.vertices, X.similarity_edges(spark, SF)))
    rows = lambda df: sorted((r.src, r.dst, r.w, r.starts, -1 if r.ends is None else r.ends) for r in df.collect())
    assert rows(g.lines) == rows(joined)
    for batch in range(X.BATCHES):
        strong = [{(r.src, r.dst, r.w) for r in P.strong_new_edges(lines, g.vertices, batch, 700_000).collect()} for lines in (g.lines, joined)]
        assert strong[0] == strong[1]
    known = {r.id for r in g.vertices.where("gt_class is not null").collect()}
    assert all(r.free == (not known & {r.src, r.dst}) for r in g.lines.collect())


def test_an_engine_over_many_vertices_broadcasts_nothing(spark, monkeypatch):
    """Neither edges nor tables of a row a vertex, sweeps that split components and the recompute beside them included."""

    def run():
        g = X.similarity_graph(spark, SF)
        made, other = N.Engine(g, Q.DELTA, Q.TAU, max_iterations=3, numeric=FIXED), recompute(g, 1, Q.DELTA, 1, FIXED)[0]
        made.run(2)
        return [sorted(map(tuple, df.collect())) for df in (made.all_labels(), made.metrics_table().drop("time_ms"), other.labels)]

    want = run()
    for module, name, value in ((R, "BROADCAST_ROWS", 0), (N, "BROADCAST_ROWS", 0), (R, "ROWS_PER_TASK", 1000), (N, "ROWS_PER_TASK", 0), (C, "FEW", 0), (R, "SPLIT", 2)):
        monkeypatch.setattr(module, name, value)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    done = store.executionsCount()
    assert run() == want
    bus.waitUntilEmpty()
    plans = store.executionsList()
    plans = [plans.apply(i).physicalPlanDescription() for i in range(plans.size())][done - store.executionsCount() :]
    assert len(plans) > 20 and not [p for p in plans if "BroadcastExchange" in p]


def broadcast_rows(spark, done: int) -> list[int]:
    """Rows of every broadcast of the queries after the first ``done``."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    of, ran, out = lambda seq: [seq.apply(i) for i in range(seq.size())], store.executionsList(), []
    for run in of(ran)[done - store.executionsCount() :]:
        values = store.executionMetrics(run.executionId())
        for node in of(store.planGraph(run.executionId()).allNodes()):
            if node.name() == "BroadcastExchange":
                rows = [values.get(m.accumulatorId()) for m in of(node.metrics()) if m.name() == "number of output rows"]
                out += [int(r.get().replace(",", "")) if r.isDefined() else 0 for r in rows]
    return out


@pytest.mark.parametrize("name", ["dynamic_label_propagation", "engine_metrics", "run_summary", "engine_beside_recompute", "batch_accuracy"])
def test_a_whole_query_over_many_vertices_broadcasts_a_row_a_batch_at_most(spark, monkeypatch, name):
    monkeypatch.setattr(X, "BATCHES", 2)
    monkeypatch.setattr(Q, "LAST", 1)
    rows = lambda: sorted(map(tuple, Q.QUERIES[name](spark, SF).collect()))
    want = rows()
    for module, key, value in ((R, "BROADCAST_ROWS", 0), (N, "BROADCAST_ROWS", 0), (R, "ROWS_PER_TASK", 1000)):
        monkeypatch.setattr(module, key, value)
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    done = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert rows() == want
    assert max(broadcast_rows(spark, done), default=0) <= X.BATCHES


def test_engine_metrics_are_of_a_run_to_the_stop_rule(spark):
    got = Q.QUERIES["engine_metrics"](spark, SF)
    rows = {r.batch_id: r for r in got.collect()}
    settled = Q.QUERIES["settled_engine_metrics"](spark, SF)
    assert max(r.iterations for r in rows.values()) > Q.SWEEPS
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, settled.where("converged").drop("converged").collect()))
