"""Operators that prepare training corpora; nothing else in the package imports them.

Functions that run in tasks are sent whole, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
