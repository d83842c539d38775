"""Automated data analysis on Spark."""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel with their code, so workers need not be able to import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
