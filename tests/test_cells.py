"""Sweeps over edges that lie by cells, against the sweeps over directed edges."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegraph import queries as Q
from tidegraph.operators import cells as L
from tidegraph.sources import fixtures as X
from tidegraph.storage import scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["engine_beside_recompute", "settled_engine_metrics", "propagate_converged"])
def test_runs_over_cells_have_the_same_results(spark, monkeypatch, name):
    monkeypatch.setattr(X, "BATCHES", 3)
    monkeypatch.setattr(Q, "LAST", 2)
    rows = lambda: sorted(map(tuple, Q.QUERIES[name](spark, SF).collect()))
    want = rows()
    monkeypatch.setattr(X, "CELLS", 0)
    monkeypatch.setattr(X, "BLOCK", 100)
    with scratch():
        assert X.similarity_graph(spark, SF).cells.blocks == 5 and rows() == want


def test_edges_of_cells_lie_once_and_are_never_shuffled(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 100)
    with scratch():
        made = X.similarity_cells(spark, SF, 500)
        rows = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert rows(made.lines) == rows(X.similarity_lines(spark, SF))
        edges = sum(np.frombuffer(r.counts, np.int32).sum() for r in made.tiles.collect())
        assert edges == made.lines.count()
        sums = made.sums(spark.range(500), F.col("id") % 7, F.col("id") == 3, ["id"])
        plan = sums._jdf.queryExecution().executedPlan().toString()
        tiles = plan[plan.rindex("FlatMapCoGroups") :]
        assert tiles.count("Exchange") == 1 and "Bucketed: true" in tiles


def test_sums_of_cells_are_exact(monkeypatch):
    rng, n = np.random.default_rng(1), 200
    ids = rng.permutation(n * 3)[:n].astype(np.int64)
    x, y = np.nonzero(rng.random((n, n)) < 0.3)
    w = rng.integers(900_000, 1_000_001, len(x))
    row = L.tile(0, ids, ids, x, y, w)
    tiles = pa.table({c: [v] for c, v in row.items()})
    f = [None if i % 9 == 0 else int(v) for i, v in enumerate(rng.integers(99_999_000, 100_000_001, n))]
    moved = rng.random(n) < 0.02
    part, whole, near, nudged = L._sums(tiles, pa.table({"id": ids, "f": pa.array(f, pa.int64()), "moved": moved}))
    want = [[0, 0, 0, False] for _ in range(n)]
    for a, b, v in zip(x.tolist(), y.tolist(), w.tolist()):
        for to, other in ((a, b), (b, a)):
            if f[other] is not None:
                one = want[to]
                want[to] = [one[0] + v * f[other], one[1] + v, one[2] + 1, one[3] or bool(moved[other])]
    assert [list(r) for r in zip(part.tolist(), whole.tolist(), near.tolist(), nudged.tolist())] == want
