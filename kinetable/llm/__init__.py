"""Operators for large text corpora: dedup, filters, classifiers, extraction, encoding, sharding.

Functions that run in Python tasks are shipped by value, so executors need no package install.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
