"""PySpark-native search, ranking and exact aggregation.

Functions that run in Python workers are shipped by value, so that a job needs nothing
installed on the executors beside Spark's own Python requirements.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
