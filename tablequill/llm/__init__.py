"""Operators for preparing training data at scale: filters, joins, mixing, packing.

Nothing else in the library imports this subpackage. Its functions travel to
the Python workers by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
