"""Reliability analytics for multichannel sensor series, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so the executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
