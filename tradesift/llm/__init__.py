"""Training-data operators. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
