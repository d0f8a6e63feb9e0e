"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Its Python kernels are
shipped to executors by value, so that executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
