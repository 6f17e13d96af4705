"""Operators for preparing large text corpora. Nothing else in the library imports this package."""

from pyspark import cloudpickle

import bidflow

# Functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(bidflow)
