"""Spark-native analytics for attributed collaboration networks."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers whole, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
