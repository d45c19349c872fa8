"""Operators for preparing training text. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Executors get the functions with the task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
