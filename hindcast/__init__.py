"""Cohort features, risk models and their evaluation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
