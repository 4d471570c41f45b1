"""A PySpark-native engine for the data side of a metered web-data platform. Its functions travel to the executors by value, so a cluster needs no installed copy."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
