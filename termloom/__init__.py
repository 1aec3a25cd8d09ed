"""termloom: Spark analytics over catalogs of integer sequences and their cross-reference graph."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their jobs, so the executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
