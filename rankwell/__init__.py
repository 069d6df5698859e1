"""Batch text retrieval and its evaluation, expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
