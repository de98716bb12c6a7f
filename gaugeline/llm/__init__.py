"""Operators for training-data pipelines; nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# Task code travels by value, so executors need the listed libraries but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
