"""Document-dataset analytics and training-data preparation on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their modules, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
