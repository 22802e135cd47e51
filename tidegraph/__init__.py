"""tidegraph: label propagation on graphs that change in batches, on PySpark."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
