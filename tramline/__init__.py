"""Tramline: a Spark-native engine for checking, comparing and merging transit schedule feeds.

Everything is a DataFrame -> DataFrame operator.  Functions that run in Python workers are pickled by value,
so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
