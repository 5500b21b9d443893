"""Layered-memory analytics on Spark: turns, atoms, scenes and core as DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
