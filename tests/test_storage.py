import os

import pytest
from pyspark.sql import functions as F

from tidegraph.operators.components import connected_components
from tidegraph.storage import Table, materialize, scratch, settled, shared_dir


def tables(spark):
    path = shared_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(path) if n.startswith("table-")}


def test_scratch_drops_what_is_made_inside(spark):
    before = tables(spark)
    with pytest.raises(KeyError), scratch():
        materialize(spark.range(3))
        with scratch():
            materialize(spark.range(4))
        assert len(tables(spark) - before) == 1
        raise KeyError
    assert tables(spark) == before


def test_settled_keeps_its_result_only(spark):
    @settled
    def work(n):
        some = materialize(spark.range(n))
        Table(spark.range(2)).drop()
        return some.join(materialize(spark.range(5)), "id")

    before = tables(spark)
    with scratch():
        assert work(3).count() == 3 and len(tables(spark) - before) == 1
    assert tables(spark) == before


def test_components_compute_their_edges_once(spark):
    ran, before = spark.sparkContext.accumulator(0), tables(spark)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    edges = spark.range(40, numPartitions=2).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).mapInArrow(count, "src long, dst long")
    with scratch():
        out = connected_components(edges)
        assert out.where("root = 0").count() == 41 and out.where("root != 0").isEmpty()
    assert ran.value == 40 and tables(spark) == before
