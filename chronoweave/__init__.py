"""Temporal-interval analytics on Spark: DataFrame plans keyed by document."""

import sys

from pyspark import cloudpickle

# Executors get the functions with the task, so a cluster needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
