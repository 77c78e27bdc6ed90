"""canopy: hierarchical retrieval and planning analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that these need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
