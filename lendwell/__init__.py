"""Lending-decision analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Kernels travel to the tasks with their helper functions, so that executors
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
