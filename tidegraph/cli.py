"""Command line: generate a graph and its batches, run the engine, compare with the full recompute, write results."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession, functions as F

from tidegraph.config import RunConfig, parse
from tidegraph.plans.engine import Engine
from tidegraph.plans.evaluate import accuracy, recompute, run_summary
from tidegraph.sources import text
from tidegraph.sources.batches import batch_summary, gen_batches
from tidegraph.sources.generate import gen_graph


def run(spark: SparkSession, config: RunConfig) -> dict:
    """One whole run; returns the summary row as a dict."""
    say = print if config.verbose else (lambda *_: None)
    out = config.output_dir.rstrip("/")
    if not text.make_directory(spark, out):
        raise OSError(f"cannot create {out}")
    say(config)
    labels, edges = gen_graph(spark, config.total_nodes, config.avg_degree, config.seed)
    text.write_graph(edges, labels, f"{out}/graph")
    graph = gen_batches(labels, edges, config)
    if config.verbose:
        batch_summary(graph).orderBy("batch_id").show()
    engine = Engine(graph, config.delta, config.tau, max_iterations=config.max_iterations, check=True)
    for b in range(config.num_batches):
        engine.process_batch(b)
        say("batch %d: %.0f ms, accuracy %.6f, %d sweeps, converged %s, %d components, %d strong edges" % engine.metrics[-1])
    text.write_labels(engine.all_labels(), f"{out}/predicted")
    text.write_metrics(engine.metrics_table(), f"{out}/results")
    baseline = None
    if config.validate:
        result, baseline = recompute(graph, config.num_batches - 1, config.delta, config.max_iterations)
        every = graph.vertices.select("id").join(result.labels, "id", "left").select("id", F.coalesce("f", F.lit(0.5)).alias("f"))
        text.write_labels(every, f"{out}/baseline")
        say("full recompute: %.0f ms, %d sweeps, accuracy %.6f" % (baseline, result.iterations, accuracy(result.labels, graph.vertices, config.num_batches - 1).first()["accuracy"]))
    summary = run_summary(engine.metrics_table(), baseline).first().asDict()
    say(summary)
    return summary


def main(argv: list[str] | None = None) -> int:
    config = parse(sys.argv[1:] if argv is None else argv)
    run(SparkSession.builder.appName("tidegraph").getOrCreate(), config)
    return 0


if __name__ == "__main__":
    sys.exit(main())
