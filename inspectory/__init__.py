"""Spark-native analytics for fleets of inspection models."""

import sys

from pyspark import cloudpickle

# Executors receive the functions themselves, so they need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
