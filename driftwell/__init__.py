"""Driftwell: analytics over replicated file collections, and training-data jobs, on Spark."""

from pyspark import cloudpickle as _cloudpickle

import driftwell as _self

# Functions that run inside Python workers travel with the job, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_self)
