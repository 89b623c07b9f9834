"""Ship-radio (AIS) analytics on Spark DataFrames, batch and streaming."""

import sys

from pyspark import cloudpickle

# Functions and stateful processors travel to the executors by value, so a job started anywhere needs no --py-files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
