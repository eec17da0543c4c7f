"""Training-data operators: scoring, deduplication, privacy, mixing and tokenisation on Spark.

Functions of this subpackage run inside Spark's Python workers; they are shipped by value,
so a cluster needs no copy of the package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
