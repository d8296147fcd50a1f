"""Spark-native market and sentiment analytics engine."""

import sys

from pyspark import cloudpickle

# Executors get the functions they run by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
