"""Lifecycle, verification and corpus analytics expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors may lack the package on their path, so its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
