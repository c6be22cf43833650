"""Operators for training-data corpora: filters, deduplication, mixing, packing and search.

Functions of this package that run on executors are shipped by value, so a cluster needs its libraries but not this
repository on the workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
