"""Household-panel analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions used inside Arrow tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
