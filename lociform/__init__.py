"""Spark-native genomic association analytics: operators as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python workers get our functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
