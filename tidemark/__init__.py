"""tidemark: time-series and panel analytics as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions go to the executors by value, so that the package needn't be installed or on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
