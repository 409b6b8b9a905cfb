"""Explore, clean and model any table with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with the tasks, so that executors need no copy
# of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
