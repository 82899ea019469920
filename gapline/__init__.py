"""Spark-native review analytics: parsing, entity work, evidence, scoring and metrics as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions by value, so they run where the package isn't installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
