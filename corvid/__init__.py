"""Spark-first document retrieval, ingestion, mining and evaluation engine.

Python functions of this package that run on executors are pickled by value, so an
executor needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
