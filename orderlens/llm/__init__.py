"""Operators for large text corpora; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a session whose workers
# have no copy of the library can run them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
