"""Training-data operators.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Python workers get this subpackage's functions by value, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
