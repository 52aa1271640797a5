"""Quire: document analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with each job, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
