"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Functions that run in Python workers travel by value, so executors need not have the library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
