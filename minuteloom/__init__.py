"""minuteloom: a PySpark-native analytics engine for hierarchical meeting records.

Functions that run in Python workers are pickled by value, so that a job needs no copy of this package
on the executors' import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
