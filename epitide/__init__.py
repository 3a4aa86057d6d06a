"""Surveillance time-series analytics as Spark DataFrame operators."""
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Arrow functions carry the package's helpers with them, so executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
