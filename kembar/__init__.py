"""Finds stored texts that resemble new ones, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python functions travel whole to the workers, which then need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
