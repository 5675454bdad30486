"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the query, so that executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
