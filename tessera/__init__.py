"""Spark-native ingestion, typing, storage and checking of tabular knowledge sources."""
import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its few Python functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
