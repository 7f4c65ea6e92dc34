"""mergeloom: a PySpark engine for comparing, merging and tracing versioned data.

Functions that run in Python workers are shipped with the job itself, so a
cluster needs no copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
