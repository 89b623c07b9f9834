"""Training-data operators over text tables. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a job needs no --py-files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
