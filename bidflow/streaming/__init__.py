"""Structured Streaming forms: native operators and keyed stateful processors."""

from pyspark import cloudpickle

import bidflow

# Processors travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(bidflow)
