"""Operators for training-data pipelines: filters, mixing, deduplication, scoring and formatting.

Nothing else in the library imports this package.  Its task functions are pickled by value, so executors
need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
