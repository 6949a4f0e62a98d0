"""Support-ticket analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Tasks carry the functions of this package with them, so the workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
