"""graphloom: a PySpark-native analytics engine over property graphs, vectors, logs and conversations."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the plan, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
