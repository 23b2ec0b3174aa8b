"""Audit, copy, restore and clean-up jobs for block inventories, written as Spark DataFrame code.

Every operator takes DataFrames and returns DataFrames; none keeps a session or state of its own.
"""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
