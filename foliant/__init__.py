"""Foliant: a corpus-scale document engine on Spark DataFrames.

Functions that run in Python workers are shipped by value, so a job needs no
copy of this package on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
