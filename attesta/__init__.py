"""Evidence-grounded lead scoring as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
