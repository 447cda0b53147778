"""lamina: a PySpark-native engine for layout-aware document batches."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to executors with their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
