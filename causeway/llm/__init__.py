"""Operators for preparing text corpora at scale.

Nothing outside this subpackage imports it; it can be removed whole.
"""

import sys

from pyspark import cloudpickle

# Tasks carry the code of this subpackage with them, so that executors need not have it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
