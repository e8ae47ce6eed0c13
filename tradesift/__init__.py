"""A Spark-native engine that finds large share-sale transactions in noisy text and structured trade feeds."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
