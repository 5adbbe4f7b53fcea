"""Classify web-request traffic and analyse the resulting log, on Spark."""

import sys

from pyspark import cloudpickle

from requestsieve.settings import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]

# Functions that run in Python workers travel with the plan, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
