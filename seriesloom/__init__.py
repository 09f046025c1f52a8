"""seriesloom: a Spark-native engine for large collections of dated series."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
