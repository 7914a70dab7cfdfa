"""quarry: passage retrieval and rank evaluation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions that run in Python workers travel with the task, so that a cluster
# needs no copy of this package on its executors and any start folder works.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
