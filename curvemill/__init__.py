"""Functional fine-mapping analytics on Spark.

The package is pure Python; functions that run on executors are shipped by
value, so a cluster needs PySpark, pyarrow, pandas and numpy but no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
