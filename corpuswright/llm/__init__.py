"""Operators for preparing training data for language models.

Functions that run in Python workers are shipped by value with each job, so
executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
