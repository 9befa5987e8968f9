"""wayfare: curate, index and search a place-recommendation corpus with Spark DataFrames."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Functions sent to Python workers travel by value, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
