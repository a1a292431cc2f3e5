"""Recall analytics over saved-content libraries, as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
