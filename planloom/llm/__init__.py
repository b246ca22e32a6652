"""Operators for training-data pipelines; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this subpackage with their plan, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
