"""Run configuration and its command-line form."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class RunConfig:
    """All settings of a run. ``tau`` < 0 means the mean edge weight."""

    total_nodes: int = 50_000
    avg_degree: int = 5
    num_batches: int = 10
    seed: int = 42
    tau: float = -1.0
    delta: float = 1e-4
    max_iterations: int = 100_000
    ground_truth_fraction: float = 0.01
    unlabeled_fraction: float = 0.90
    deleted_fraction: float = 0.09
    output_dir: str = "output/"
    validate: bool = True
    verbose: bool = True

    def check(self) -> RunConfig:
        if self.total_nodes < 2:
            raise ValueError("total_nodes must be over 1")
        for name in ("avg_degree", "num_batches", "delta"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be over 0")
        if not 0 < self.ground_truth_fraction < 1:
            raise ValueError("ground_truth_fraction must lie between 0 and 1")
        if self.ground_truth_fraction + self.unlabeled_fraction + self.deleted_fraction > 1.001:
            raise ValueError("the fractions of a batch add up to more than 1")
        if self.max_iterations < 0:
            raise ValueError("max_iterations must not be negative")
        return self


#: Option: field. Fixed names of the command line.
OPTIONS = {
    "--totalNodes": "total_nodes", "--avgDegree": "avg_degree", "--numBatches": "num_batches", "--seed": "seed", "--tau": "tau",
    "--delta": "delta", "--maxIter": "max_iterations", "--gtFraction": "ground_truth_fraction", "--unlabeledFraction": "unlabeled_fraction",
    "--deletedFraction": "deleted_fraction", "--output": "output_dir",
}


def parse(argv: list[str]) -> RunConfig:
    """The configuration of a command line; unknown options and missing values exit with an error."""
    parser = argparse.ArgumentParser(prog="tidegraph", description="Label propagation on a graph that changes in batches.", allow_abbrev=False)
    kinds = {f.name: type(f.default) for f in fields(RunConfig)}
    for option, name in OPTIONS.items():
        parser.add_argument(option, dest=name, type=kinds[name], default=getattr(RunConfig, name))
    parser.add_argument("--validate", dest="validate", action="store_true", default=True)
    parser.add_argument("--noValidate", dest="validate", action="store_false")
    parser.add_argument("--verbose", dest="verbose", action="store_true", default=True)
    parser.add_argument("--quiet", dest="verbose", action="store_false")
    values = parser.parse_args(argv)
    try:
        return RunConfig(**vars(values)).check()
    except ValueError as error:
        parser.error(str(error))
