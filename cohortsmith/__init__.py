"""Population-cohort and surveillance analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Model fits run in Python workers.  Pickling this package by value lets them
# run on executors that do not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
