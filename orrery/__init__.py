"""Spark-native analytics for archives of scored candidates, their evaluation and training data."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
