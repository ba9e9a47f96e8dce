"""Operators for the preparation of training text. Nothing else in the library imports them.

Their functions travel to the executors by value, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
