"""A PySpark engine for persona-conditioned prompt experiments.

Functions of this package that run inside tasks travel with the task, so executors
need not have the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
