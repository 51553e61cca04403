"""Entropy estimation over frame-by-coordinate trajectories, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
