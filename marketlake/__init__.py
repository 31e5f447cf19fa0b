"""Set-based market analytics on Spark: every operator is a ``DataFrame -> DataFrame`` function."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
