"""Operators for large-scale training-data work; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
