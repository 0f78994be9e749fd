"""Audit-log analytics as PySpark DataFrame and Structured Streaming operators."""

import sys

from pyspark import cloudpickle

# The functions that run in Python workers travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
