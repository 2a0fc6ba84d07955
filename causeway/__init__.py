"""causeway: causal analytics over tables, expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Tasks carry this package's code with them, so that executors need not have it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
