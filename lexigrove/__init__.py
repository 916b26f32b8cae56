"""lexigrove: analytics over large annotated text corpora, written as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their tasks, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
