"""lacuna: gap filling for multi-station panels, and corpus operators, on PySpark."""

import sys

from pyspark import cloudpickle

# Functions for executors travel whole, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
