"""Panels, honest evaluation and text corpora on Spark DataFrames.

Functions that run on executors are shipped by value, so workers do not need the package on
their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
