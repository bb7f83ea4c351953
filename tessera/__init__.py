"""A PySpark-native engine for collecting, scoring, deduplicating and ranking semi-structured records."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors get this package's functions by value, so they need no copy of it.
register_pickle_by_value(sys.modules[__name__])
