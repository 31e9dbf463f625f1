"""Operators of a training-data pipeline; nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors by value, so that a cluster needs no copy of the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
