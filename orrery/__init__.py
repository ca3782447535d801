"""orrery: entity and literature analytics as plain Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions shipped to tasks carry their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
