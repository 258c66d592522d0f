"""Mail-archive analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped with the task, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
