"""Panel analytics on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so that it need not be installed on every machine.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
