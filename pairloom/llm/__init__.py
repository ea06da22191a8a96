"""Operators of a training-data pipeline: extraction, filters, deduplication, mixing."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the tasks by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
