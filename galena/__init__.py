"""Galena: vector search and data preparation as Spark plans."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
