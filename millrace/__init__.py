"""Spark-native preparation of multi-modal training data.

Functions of this package travel to the executors by value, so executors need
no copy of it.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
