"""Spark-native scoring of classifier runs and auditing of the data behind them."""

import sys

from pyspark import cloudpickle

# Ship the few Python functions that run inside tasks by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
