"""Spark-native operators for text-rich review analytics."""

import sys

from pyspark import cloudpickle

# tasks carry the library's functions by value, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
