"""Spark-native attribution of anomalies in multi-service metric recordings."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so that they need no copy
# of this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
