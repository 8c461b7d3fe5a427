"""Operators of a training-data pipeline: language, tokens, duplicates, toxicity, shards, leaks.

Nothing else in the library imports this subpackage. Tasks get its code by value, so
executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
