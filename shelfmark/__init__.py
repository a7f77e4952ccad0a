"""Price-history, entity-resolution and training-corpus analytics on Spark.

Python functions of this package run on executors without the package being
installed there: they are pickled by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
