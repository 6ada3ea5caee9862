"""Email-threat analytics as PySpark DataFrame operators and column functions."""

import sys

from pyspark import cloudpickle

# Python helpers travel with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
